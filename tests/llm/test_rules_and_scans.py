"""Quality rules, sharding, secret scans, license scans, line dedup: each against a plain version, and the odd cases."""

import hashlib
import random
import re
import zlib

from brindle.llm.licenses import TEMPLATES, license_scan, needed_words
from brindle.llm.line_dedup import line_dedup
from brindle.llm.quality import TAIL, THRESHOLD, quality_rules
from brindle.llm.secrets import BASE, RULES, secret_scan, trigram_query
from brindle.llm.sharding import jump_sharding

DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \n\t\n "), (4, "x"), (5, "x"), (5, "x"), (None, "a null id")]


def test_quality_base_columns_against_plain_rules(spark):
    rng = random.Random(1)
    rows = list(ODD)
    for i in range(60):
        lines = [" ".join(rng.choice(["red", "green", "blue#", "é|à", "<b>"]) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 12))]
        rows.append((100 + i, rng.choice(["\n", "\n\n", " \r\n"]).join(lines)))
    rows.append((500, "long " * 30_000))
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(40)] + [(None, 1), (7, None)], "doc_id long, quality int")
    docs = spark.createDataFrame([(*r, "clash") for r in rows], DOCS + ", kept string")
    got = quality_rules(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = []
    for d, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        at, hit = {}, set()
        for i in range(len(w) - 4):
            at.setdefault(tuple(w[i : i + 5]), []).append(i)
        for places in at.values():
            if len(places) > 1:
                hit.update(p + k for p in places for k in range(5))
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed))
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)
    assert not any(r.kept for r in got if r.base_failed)
    assert quality_rules(docs.limit(0), labels).count() == 0 and quality_rules(docs, labels.limit(0)).count() == len(rows)


def test_jump_hash_moves_rows_only_to_the_new_shard(spark):
    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % (1 << 64)
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    rows = [(i * 7919, f"t{i}") for i in range(2000)] + ODD
    out = jump_sharding(spark.createDataFrame([(*r, 3) for r in rows], DOCS + ", slot int")).collect()
    assert len(out) == len(rows)
    slots = {}
    for r in out:
        k = r.doc_id or 0
        assert r.shard == jump(k, 16) and r.grown_shard == jump(k, 17) and r.grown_shard in (r.shard, 16)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert jump_sharding(spark.createDataFrame([], DOCS)).count() == 0


def test_secret_spans_against_regex_search(spark):
    rng = random.Random(5)
    parts = ["password = 'hunter2hunter'", "api_key: abcdef", "token=abc", "API-KEY=1234567", "AKIA" + "A" * 16, "AKIAshort", "f" * 24, "é" * 3, "0123456789abcdef" * 2, "plain words", "ghp_" + "a" * 36, "secretsecret=xxxxxx", "xoxb-1234567890-abc", "-----BEGIN RSA PRIVATE KEY-----", "😀"]
    rows = [*ODD, *((100 + i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for i in range(80)), (300, "pad " * 20_000 + "password: longenough")]
    got = secret_scan(spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", found int")).select("doc_id", "text", "found").collect()
    assert len(got) == len(rows)
    for r in got:
        want = []
        for n, rule in enumerate(RULES):
            want += [(m.start(), n, m.end()) for m in re.finditer(rule.pattern, r.text or "") if len(m[rule.group]) >= rule.least]
        assert sorted((s.start, s.n, s.end) for s in r.found) == sorted(want)
    assert secret_scan(spark.createDataFrame([], DOCS)).count() == 0


def test_trigram_queries_are_mandatory():
    assert trigram_query(BASE[2].pattern) is None
    assert trigram_query("AKIA[A-Z0-9]+") == (frozenset({"aki", "kia"}),)
    words = trigram_query(BASE[0].pattern)
    for text in ("password=abcdef", "API_KEY: abcdef", "apikey=abcdef", "Token = abcdef"):
        assert any(all(g in text.lower() for g in alt) for alt in words)


def test_licenses_against_dice_by_hand(spark):
    def grams(text):
        w = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
        return set(zip(w, w[1:], strict=False))

    rng = random.Random(2)
    rows = list(ODD)
    for i, t in enumerate(TEMPLATES.values()):
        w = t.split()
        rows += [(100 + i, f"Prose before.\n{t}\nProse after."), (200 + i, " ".join(w[: max(2, len(w) - rng.randint(0, 3))])), (300 + i, "one\n\n" + "\n".join(w) + "\n\ntwo")]
    rows.append((999, "no license " * 5000))
    got = {(r.doc_id, x.license): (x.n_units, round(x.dice, 9)) for r in license_scan(spark.createDataFrame([(*r, "c") for r in rows], DOCS + ", licenses string")).collect() for x in r.licenses}
    want = {}
    for d, t in rows:
        clean = re.sub(r"[^a-z0-9\n]+", " ", (t or "").lower())
        units = clean.split("\n") + [p for p in re.split(r"\n ?\n", clean) if "\n" in p] + ([clean] if re.search(r"\n ?\n", clean) else [])
        units = [" ".join(u.split()) for u in units]
        parts = re.split(r"[.!?][^a-z0-9 \t\r\n]*[ \t\r\n]+|\n[ \t\r]*\n", (t or "").lower())
        units += sorted({" ".join(re.sub("[^a-z0-9]+", " ", x).split()) for x in parts} - set(units))
        for u in units:
            g = grams(u)
            best = max(((2 * len(g & grams(x)) / (len(g) + len(grams(x))), n) for n, x in TEMPLATES.items() if g), default=(0, ""))
            if best[0] >= 0.8:
                n, dice = want.get((d, best[1]), (0, 0))
                want[d, best[1]] = (n + 1, round(max(dice, best[0]), 9))
    assert got == want and len(want) > 20
    assert license_scan(spark.createDataFrame([], DOCS)).count() == 0


def test_licenses_inside_lines_over_lines_and_as_whole_bodies(spark):
    body = "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + TEMPLATES["MIT-body"]
    wrap = lambda t, n: "\n".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    rows = [
        (1, "Some prose. Released under the MIT License. More prose."),
        (2, "Some words stand here before it. This work is licensed under the GNU General\nPublic License, version 3. And more\nprose follows here."),
        (3, body),
        (4, "\n\n".join(wrap(p, 9) for p in body.split("\n\n"))),
        (5, "Before. " + TEMPLATES["MIT-grant"] + "\n\nAfter " + "word " * 400),
        (6, TEMPLATES["BSD-3-Clause-body"].replace("copyright holder", "Example Organisation")),
        (7, "The license of the released software is of no kind that anybody here would know."),
        (8, "Released under the MIT License. Released under the MIT License. Yes, and more words stand behind it."),
        (9, "a license. " * 100_000 + "Licensed under CC BY 4.0. " + "x" * 200_000),
    ]
    got = {r.doc_id: {x.license: (x.n_units, x.dice) for x in r.licenses} for r in license_scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1] == {"MIT": (1, 1.0)} and set(got[2]) == {"GPL-3.0"} and got[7] == {} and got[8] == {"MIT": (1, 1.0)} and set(got[9]) == {"CC-BY-4.0"}
    assert {"MIT-body", "MIT-grant"} <= set(got[3]) and got[3].keys() == got[4].keys() and "MIT-grant" in got[5] and "BSD-3-Clause-body" in got[6]


def test_needed_words_rule_out_no_unit_that_fits():
    rng = random.Random(5)
    needed = needed_words(TEMPLATES, 0.8)
    for t in TEMPLATES.values():
        w = re.sub(r"[^a-z0-9]+", " ", t.lower()).split()
        want = set(zip(w, w[1:], strict=False))
        for _ in range(300):
            kept = [x for x in w if rng.random() > 0.15]
            g = set(zip(kept, kept[1:], strict=False))
            if 2 * len(g & want) >= 0.8 * (len(g) + len(want)):
                assert any(x in " ".join(kept) for x in needed)
    assert len(needed) < 100


def test_repeated_passages_go_and_the_first_stays(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = "\n".join(" ".join(word() for _ in range(9)) for _ in range(12))
    wrapped = " ".join(word() for _ in range(60))
    rows = [(i, "\n".join([*(" ".join(word() for _ in range(8)) for _ in range(rng.randint(0, 4))), passage, wrapped, *(" ".join(word() for _ in range(7)) for _ in range(3))])) for i in range(20)]
    clean = [(100 + i, "\n".join(" ".join(word() for _ in range(8)) for _ in range(6))) for i in range(20)]
    out = {r.doc_id: r for r in line_dedup(spark.createDataFrame([(*r, 1) for r in rows + clean], DOCS + ", removed int")).collect()}
    texts = dict(rows + clean)
    assert all(out[d].clean_text == t for d, t in clean) and out[0].clean_text == texts[0]
    for d in range(1, 20):
        assert wrapped not in out[d].clean_text and len(out[d].clean_text) < len(texts[d]) - len(passage) * 0.6
        assert all(line in texts[d].split("\n") for line in out[d].clean_text.split("\n"))
    odd = {(r.doc_id, r.text): r.clean_text for r in line_dedup(spark.createDataFrame(ODD, DOCS)).collect()}
    assert all(v == t for (_, t), v in odd.items()) and len(odd) == len(set(ODD))
    assert line_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_repeated_passages_of_few_short_lines_go_in_any_context(spark):
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    line = lambda n=9: " ".join(word() for _ in range(n))
    rows, passages = [], {}
    for p in range(60):
        body = [line() for _ in range(3 + p % 6)] if p % 10 else [line(22), line(6), line(17)]
        if p % 10 == 5:
            body = [word() for _ in range(12)]  # lines of a word, as in a list
        passages[p] = body
        for copy in (0, 1):
            rows.append((2 * p + copy, [line() for _ in range(rng.randint(1, 4))], ["", *body] if p % 7 == 0 else body, [line() for _ in range(rng.randint(1, 4))]))
    texts = {d: "\n".join([*a, *b, *c]) for d, a, b, c in rows}
    out = {r.doc_id: r for r in line_dedup(spark.createDataFrame(list(texts.items()), DOCS)).collect()}
    for d, before, body, after in rows:
        blank = [""] if d % 2 and body[0] == "" else []
        assert out[d].clean_text == (texts[d] if d % 2 == 0 else "\n".join([*before, *blank, *after]))
        assert bool(out[d].removed) == bool(d % 2)
    again = "\n".join([line()] * 6)
    lone = line()
    odd = [(1, f"{line()}\n{again}"), (2, f"{line()}\n{lone}\n{line()}"), (3, f"{line()}\n{lone}\n{line()}")]
    out = {r.doc_id: r.clean_text for r in line_dedup(spark.createDataFrame(odd, DOCS)).collect()}
    assert out[2] == odd[1][1] and out[3] == odd[2][1] and out[1].split("\n") == odd[0][1].split("\n")[:3]


def test_equal_hashes_of_different_bytes_remove_nothing(spark, monkeypatch):
    from pyspark.sql import functions as F

    from brindle.llm import line_dedup as module

    monkeypatch.setattr(module, "_keys", lambda body: (F.lit(1).cast("long").alias("k1"), F.lit(2).cast("long").alias("k2")))
    rows = [(1, "a" * 200), (2, "b" * 200), (3, "c" * 200)]
    out = module.line_dedup(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id, r.clean_text) for r in out) == rows


def test_quality_ratio_and_verdict_against_plain_counts(spark):
    import math

    from pyspark.sql import functions as F

    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words[:200] if i % 3 else words[150:]) for _ in range(rng.randint(12, 90)))) for i in range(120)] + [(500, "x y"), (501, None), (7, "a repeated id " + " ".join(words[:30]))]
    good = {i for i in range(0, 90) if i % 3} - {1} | {7}
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1) for i in good] + [(i, 0) for i in range(90, 120)] + [(3, 1), (None, 1)], "doc_id long, quality int")
    good |= {3}
    buckets, limit = 64, 40
    hashes = spark.createDataFrame([(i,) for i in good], "i long").select("i", F.xxhash64("i").alias("h")).collect()
    target = {r.i for r in sorted(hashes, key=lambda r: (r.h, r.i))[:limit]}
    split = {k: t.split() for k, (_, t) in enumerate(rows) if t}
    grams = {w: None for ws in split.values() for w in ws}
    for r in spark.createDataFrame([(w, w[-TAIL:]) for w in grams], "w string, t string").select("w", F.pmod(F.xxhash64("w"), F.lit(buckets)).alias("a"), F.pmod(F.xxhash64("t", F.lit(0)), F.lit(buckets)).alias("b")).collect():
        grams[r.w] = (r.a, r.b)
    raw, top = [0] * buckets, [0] * buckets
    for k, ws in split.items():
        for w in ws:
            for g in grams[w]:
                raw[g] += 1
                top[g] += rows[k][0] in target
    ratio = [math.log((top[b] + 1) / (sum(top) + buckets)) - math.log((raw[b] + 1) / (sum(raw) + buckets)) for b in range(buckets)]
    want = {}
    for k, (d, t) in enumerate(rows):
        ws = split.get(k, [])
        want[d, t] = sum(ratio[g] for w in ws for g in grams[w]) / (2 * len(ws)) if ws else 0.0
    got = quality_rules(docs, labels, threshold=-0.02, buckets=buckets, target_rows=limit).select("doc_id", "text", "llr", "base_failed", "kept").collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.llr - want[r.doc_id, r.text]) < 1e-9
        assert r.kept == (not r.base_failed and r.llr >= -0.02)
    assert {r.kept for r in got if not r.base_failed} == {True, False} and THRESHOLD < 0


def test_columns_of_any_name_stay_as_they_are(spark):
    names = ["row", "words", "lines", "windows", "twins", "w", "total", "walk", "block", "n", "start", "x", "b", "mask", "id", "key", "row_key", "marks", "got", "clean", "bodies", "u", "at", "first", "k1", "back", "_words", "_block", "_id"]
    rows = [(i, f"line one of {i}\nthe same line here and here\nand the same line again and again\npassword: abcdefgh", *[f"{n}{i}" for n in names]) for i in range(6)]
    docs = spark.createDataFrame(rows, DOCS + "".join(f", `{n}` string" for n in names))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for out in (quality_rules(docs, labels), jump_sharding(docs), secret_scan(docs), license_scan(docs), line_dedup(docs)):
        assert out.columns[: len(docs.columns)] == docs.columns
        assert sorted(tuple(r)[: len(docs.columns)] for r in out.collect()) == sorted(rows)
    assert len(line_dedup(docs).where("clean_text <> text").collect()) == 5


def plain_line_dedup(rows, wrap=160, least=40):
    """Texts without blank lines: repeated shortest runs of lines, looked for from both ends, go but for their first place."""
    places = {}
    for d, text in sorted(rows):
        x = text.split("\n")
        units = set()
        size = lambda i, n: sum(map(len, x[i : i + n])) + n - 1
        for i in range(len(x)):
            after = next((n for n in range(2, len(x) - i + 1) if size(i, n) >= least), 0)
            before = next((n for n in range(2, i + 2) if size(i - n + 1, n) >= least), 0)
            units |= ({(i, after)} if after else set()) | ({(i - before + 1, before)} if before else set())
            units |= {(i, 1)} if len(x[i]) >= wrap else set()
        for i, n in units:
            places.setdefault("\n".join(x[i : i + n]), []).append((d, i, n))
    gone = {}
    for body in places.values():
        first = min(body)
        for d, i, n in body:
            if (d, i) != first[:2]:
                begin = max(i, first[1] + n) if d == first[0] else i
                gone.setdefault(d, set()).update(range(begin, i + n))
    return {d: "\n".join(y for k, y in enumerate(text.split("\n")) if k not in gone.get(d, ())) for d, text in rows}


def test_line_dedup_against_a_plain_version(spark):
    rng = random.Random(23)
    lines = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(rng.choice([1, 1, 2, 5, 9, 45]))) for _ in range(40)]
    rows = [(i, "\n".join(rng.choice(lines) if rng.random() < 0.7 else f"only {i} {rng.random()}" for _ in range(rng.randint(1, 14)))) for i in range(120)]
    rows += [(500, "\n".join(lines) + "\n" + "\n".join(lines)), (501, "\n".join(f"long text, line {k % 900}" for k in range(3000)))]
    got = {r.doc_id: r.clean_text for r in line_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    want = plain_line_dedup(rows)
    assert got == want and sum(want[d] != t for d, t in rows) > 50


def test_helpers():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0") and zlib.crc32(b"") == 0
