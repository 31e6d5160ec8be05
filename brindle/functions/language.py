"""Sentences, names and small parsers over text, as native column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import _let, collapsed, folded, tokens

#: Signs that close a sentence behind its end mark, and abbreviations that do not end one.
CLOSERS = "\"'”’»›）)】〕]」』"
ABBREVIATIONS = ("Mr.", "Mrs.", "Dr.", "Sr.", "Sra.", "M.", "Mme.", "St.")
#: Words that open a question or sentence and name nothing.
ENTITY_STOP = (
    "Compare How What Why When Where Who Which Does Did Can Could Should Shall May Might The A An This That These Those There Here It I You We They He She My Your Our Their In On At For With From "
    "About Into Over Under Per Also Please Note Hi Hello Thanks Thank Yes No Quel Quels Qui Quand Comment Pourquoi Wer Was Wie Wann Wo Warum Welche Welcher Welches"
).split()
MODEL_CODE = r"\b[A-Z]{1,4}-?\d{1,4}(?:[-/]\d{1,4})*\b"
CAPITALISED = r"\b[A-Z][a-z]+(?:\s+(?:[A-Z][a-z]+|the))*(?=\b)"
#: Greetings that need no retrieval.
GREETINGS = (
    "hi", "hello", "hey", "thanks", "thank you", "thanks a lot", "bye", "goodbye", "good morning", "good afternoon", "good evening", "ok", "okay", "cool", "great",
)
GREETING_CHARS, GREETING_WORDS = 40, 4


def _compatible() -> tuple[str, str]:
    """Signs whose compatible form (NFKC) is one other letter, and these letters, from the Unicode tables."""
    forms = [(c, unicodedata.normalize("NFKC", c)) for c in map(chr, range(0xA0, 0x1F200)) if not 0xD800 <= ord(c) < 0xE000]
    kept = [(c, f) for c, f in forms if f != c and len(f) == 1 and f.isascii() and f.isalpha()]
    return "".join(c for c, _ in kept), "".join(f for _, f in kept)


_FORMS, _LETTERS = _compatible()


def sentences(text: Column) -> Column:
    """Sentences of a text, in order, blank ones left out.

    ``.``, ``!`` and ``?`` end one where white space follows, their CJK forms always; closing signs stay with it. The full
    stop of an abbreviation is no end. A sign that texts do not hold marks the ends before the text is split.
    """
    cut = "\x1e"
    marks = f"([.!?][{_escaped(CLOSERS)}]*)(?=\\s)|([。！？][{_escaped(CLOSERS)}]*)"
    short = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    marked = F.regexp_replace(F.replace(text, F.lit(cut), F.lit("")), marks, f"$1$2{cut}")
    joined = F.regexp_replace(marked, f"(?:(?<=^)|(?<=[ \\n{cut}]))({short}){cut}", "$1")
    return F.filter(F.transform(F.split(joined, cut), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def _escaped(signs: str) -> str:
    return "".join("\\" + c if c in "\"')]" else c for c in signs)


def named_entities(question: Column) -> Column:
    """Distinct model codes, then capitalised names that neither open the question nor begin with a stop word."""
    codes = F.regexp_extract_all(question, F.lit(MODEL_CODE), 0)
    names = F.regexp_extract_all(question, F.lit(CAPITALISED), 0)
    opens = question.rlike("^" + CAPITALISED)
    later = F.when(opens, F.slice(names, 2, F.greatest(F.lit(1), F.size(names)))).otherwise(names)
    return F.array_distinct(F.concat(codes, F.filter(later, lambda n: ~F.split(n, r"\s")[0].isin(ENTITY_STOP))))


def compare_queries(question: Column) -> Column:
    """A query for each named entity of a comparison, and the question itself; only the question without two entities."""
    names = named_entities(question)
    return F.when(F.size(names) >= 2, F.array_distinct(F.concat(F.array(question), F.transform(names, lambda n: F.concat(n, F.lit(" "), question))))).otherwise(F.array(question))


def names_subject(message: Column) -> Column:
    """Whether a message names what it is about: an entity, or a last word that is no stop word."""
    stop = [w.lower() for w in ENTITY_STOP]
    last = F.try_element_at(F.regexp_extract_all(F.lower(message), F.lit(r"\p{L}+"), 0), F.lit(-1))
    return (F.size(named_entities(message)) > 0) | F.coalesce(~last.isin(stop), F.lit(False))


def greeting(message: Column) -> Column:
    """The greeting that a short message is, or null. Signs in compatible forms count as the letters they stand for; what
    is no letter parts words, so that letters with dashes between them do not join to a greeting."""
    bare = F.regexp_replace(F.lower(F.translate(message, _FORMS, _LETTERS)), r"[^\p{L}]+", " ")
    return F.when((F.length(message) <= GREETING_CHARS) & F.btrim(bare).isin(*GREETINGS), F.btrim(bare))


def is_greeting(message: Column) -> Column:
    return F.coalesce(greeting(message).isNotNull(), F.lit(False))


def contains_sequence(text_tokens: Column, wanted: Column) -> Column:
    """Whether the wanted words stand in a text's words side by side and in order."""
    n = F.size(wanted)
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(text_tokens) - n + 1))
    return (n > 0) & (F.size(text_tokens) >= n) & F.exists(places, lambda i: F.slice(text_tokens, i, n) == wanted)


def quote_around(text: Column, terms: Column, width: int = 400) -> Column:
    """A window of a text around the first place of any term of more than one sign; its head without a hit."""
    low = folded(text)
    at = F.array_min(F.filter(F.transform(F.filter(terms, lambda t: F.length(t) > 1), lambda t: F.instr(low, t)), lambda p: p > 0))
    start = F.greatest(F.lit(1), F.coalesce(at, F.lit(1)) - width // 3)
    return F.btrim(F.replace(F.substring(text, start, F.lit(width)), F.lit("\n"), F.lit(" ")))


def mentions(text: Column, any_of: Column, all_of: Column) -> Column:
    """Whether a text has every one of ``all_of`` and, where ``any_of`` is not empty, one of these; case is ignored."""
    low = F.lower(text)
    has = lambda x: F.contains(low, F.lower(x))
    return F.forall(all_of, has) & ((F.size(any_of) == 0) | F.exists(any_of, has))


def marker_hit(text: Column, words: Column, marker: str) -> Column:
    """A marker of one sign anywhere, of up to three as a word, of more as the beginning of a word; ``words``: the text's."""
    if len(marker) == 1:
        return F.contains(text, F.lit(marker))
    if len(marker) < 4:
        return F.array_contains(words, F.lit(marker))
    return F.exists(words, lambda w: w.startswith(marker))


#: A choice of small words by language, one point a word of the text. A fuller table is a parameter of ``detected_language``.
STOPS = {
    "en": "the of and to in is was that it for with as his he on be at by had not are but from have they which you were her she there hi hello hey thanks".split(),
    "de": "der die und den das ist nicht ein eine dem des mit sich auf für von sie im in was auch als an es werden aus er hat dass wird bei".split(),
    "fr": "le la les des est une dans pour que qui pas sur par plus avec au ce il sont elle mais ou cette nous vous été aux du et un de en comment".split(),
    "es": "el los las una por con para del que no se su al lo como más pero sus le ya este sí porque esta entre cuando muy un en de la y es".split(),
    "it": "come con cui della gli hanno nella quando questo tutto".split(),
    "pt": "ao com como da em não os para pelo que uma você".split(),
    "nl": "aan de een en het hij in is niet van voor wie zijn".split(),
    "pl": "do na nie przez w z".split(),
    "tr": "bir bu da için ile ne ve".split(),
    "tl": "ang ano hindi ito mga na ng sa si".split(),
}
#: A choice of signs and words of one language alone, ``MARK`` points for each that a text holds.
MARKS = {
    "en": ["the", "what", "who", "how", "why", "which"],
    "es": ["ñ", "¿", "¡", "cómo", "qué", "quién", "también", "está"],
    "fr": ["ç", "œ", "ë", "ï", "û", "ê", "â", "peux", "pourquoi", "quelle", "très", "même", "être", "résum"],
    "de": ["ß", "ä", "ö", "ü", "warum", "welche", "zusammen", "wurde"],
    "it": ["chi", "cosa", "quale", "sono", "perché", "dove"],
    "pt": ["ã", "õ", "quem", "escreveu", "livro", "são", "foi"],
    "nl": ["waarom", "wordt", "heeft", "welke", "vrouw", "verhaal"],
    "pl": ["ą", "ę", "ł", "ź", "ż", "który", "dlaczego", "kto", "jest", "się"],
    "tr": ["ı", "ğ", "ş", "nedir", "nasıl", "hangi", "değil"],
    "tl": ["sino", "ano", "paano", "bakit", "mga", "ang"],
}
MARK = 3
#: Letters of scripts that name a language by themselves where they are most letters of a text; the classes read alike in
#: Java's patterns and in RE2's with ``Is`` left out.
SCRIPTS = {
    "ko": r"\p{IsHangul}",
    "zh": r"\p{IsHan}",
    "ru": r"\p{IsCyrillic}",
    "el": r"\p{IsGreek}",
    "ar": r"\p{IsArabic}",
    "he": r"\p{IsHebrew}",
    "th": r"\x{0E01}-\x{0E30}\x{0E32}\x{0E33}\x{0E40}-\x{0E46}",
    "hi": r"\x{0904}-\x{0939}\x{093D}\x{0950}\x{0958}-\x{0961}\x{0971}-\x{097F}",
}
KANA = r"\x{3040}-\x{30FF}"
#: A dictionary goes into the plan as literals; a table over this many entries is refused.
DICTIONARY_MOST = 20_000


def dictionary(table: DataFrame) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """Small words and marks by language from a table (lang, word, mark): ``detected_language``'s parameters.

    Words are lower-cased; nulls, empty words and repeated rows count nothing. A table of over ``DICTIONARY_MOST`` entries
    is refused, not cut.
    """
    clean = table.select("lang", F.lower(F.btrim("word")).alias("word"), F.coalesce("mark", F.lit(False)).alias("mark")).where("lang is not null and word <> ''").distinct()
    rows = clean.orderBy("lang", "word").limit(DICTIONARY_MOST + 1).collect()
    if len(rows) > DICTIONARY_MOST:
        raise ValueError(f"a dictionary of over {DICTIONARY_MOST} entries")
    of = lambda mark: {k: [r.word for r in rows if r.lang == k and r.mark == mark] for k in sorted({r.lang for r in rows})}
    return of(False), of(True)


def _mark_count(text: Column, line: Column, marks: list[str]) -> Column:
    """How many marks a text holds: of one sign anywhere, of up to three as a word, of more as the beginning of one.
    ``line``: the text's words, each between blanks."""
    hits = [F.contains(text, F.lit(m)) if len(m) == 1 else F.contains(line, F.lit(f" {m} " if len(m) < 4 else f" {m}")) for m in marks]
    return sum((h.cast("int") for h in hits), F.lit(0))


def latin_scores(text: Column, words: Column, stops: dict[str, list[str]] = STOPS, marks: dict[str, list[str]] = MARKS) -> Column:
    """An array of (lang, score): small words count each time, marks once each and ``MARK`` times as much."""
    line = F.concat(F.lit(" "), F.array_join(F.array_distinct(words), " "), F.lit(" "))
    small = lambda k: F.size(F.filter(words, lambda w: w.isin(stops[k]))) if stops.get(k) else F.lit(0)
    score = lambda k, x: small(k) + (MARK * _mark_count(text, x, marks[k]) if marks.get(k) else F.lit(0))
    return _let(line, lambda x: F.array(*[F.struct(F.lit(k).alias("lang"), score(k, x).alias("score")) for k in sorted(stops.keys() | marks.keys())]))


def _winner(scores: Column) -> Column:
    """The one language with the highest score: English where it has as much as any other, null where others tie."""
    best = F.array_max(F.transform(scores, lambda s: s["score"]))
    first = F.transform(F.filter(scores, lambda s: s["score"] == best), lambda s: s["lang"])
    return _let(first, lambda f: F.when(best > 0, F.when(F.array_contains(f, "en"), "en").when(F.size(f) == 1, f[0])))


def detected_language(text: Column, stops: dict[str, list[str]] = STOPS, marks: dict[str, list[str]] = MARKS) -> Column:
    """The language of a text, or null where nothing tells.

    Kana mean Japanese; a script that holds more than half of the letters names its language; else small words and
    marks of Latin languages are scored, English winning ties and any other tie telling nothing. Null and empty texts,
    figures and codes have none. ``dictionary`` reads other tables of words.
    """

    def of(t: Column) -> Column:
        letters = F.regexp_count(t, F.lit(r"\p{L}"))
        script = F.when(t.rlike(f"[{KANA}]"), "ja")
        for lang, signs in SCRIPTS.items():
            script = script.when(F.regexp_count(t, F.lit(f"[{signs}]")) * 2 > letters, lang)
        low = F.lower(t)
        words = F.regexp_extract_all(low, F.lit(r"\p{L}+"), 0)
        latin = _let(F.struct(low.alias("t"), words.alias("w")), lambda x: _let(latin_scores(x["t"], x["w"], stops, marks), _winner))
        # One pass spares texts without any such sign the count of each script.
        return F.coalesce(F.when(t.rlike(f"[{KANA}{''.join(SCRIPTS.values())}]"), script), latin)

    return _let(F.coalesce(text, F.lit("")), of)


#: Names of languages, for prompts.
LANGUAGES = {
    "ar": "Arabic", "de": "German", "el": "Greek", "en": "English", "es": "Spanish", "fr": "French", "he": "Hebrew", "hi": "Hindi", "it": "Italian", "ja": "Japanese",
    "ko": "Korean", "nl": "Dutch", "pl": "Polish", "pt": "Portuguese", "ru": "Russian", "th": "Thai", "tl": "Tagalog", "tr": "Turkish", "zh": "Chinese",
}


def language_name(code: Column) -> Column:
    out = F.lit("English")
    for k, name in LANGUAGES.items():
        out = F.when(code == k, name).otherwise(out)
    return out


def instant_title(text: Column, width: int = 60) -> Column:
    """A title from a message: blanks collapsed, cut at a word, with an ellipsis where something is cut."""
    flat = collapsed(text)
    head = F.regexp_extract(F.substring(flat, 1, width + 1), r"^(.*)\s", 1)
    cut = F.when(head != "", head).otherwise(F.substring(flat, 1, width))
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.btrim(cut), F.lit("…")))


def variants(reply: Column, most: int = 3) -> Column:
    """Query variants of a reply, a line each: numbering goes, lines of fewer than two words too, the first of equal ones stays."""
    lines = F.transform(F.split(reply, "\n"), lambda x: F.btrim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", "")))
    return F.slice(F.array_distinct(F.filter(lines, lambda x: F.size(F.split(x, r"\s+")) >= 2)), 1, most)


def first_json(reply: Column, schema: str) -> Column:
    """The first object that can be read anywhere in a reply, field by field; null where there is none.

    Each opening brace is tried in turn until an object can be read from there; what stands behind it does not matter. A
    field that is missing, or of another kind than ``schema`` says, is null and spoils no other.
    """

    def of(parts: Column) -> Column:
        rest = lambda k: F.concat(F.lit("{"), F.array_join(F.slice(parts, k, F.size(parts)), "{"))
        reads = lambda k: F.from_json(rest(k), "map<string,string>").isNotNull()
        at = F.aggregate(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(parts))), F.lit(0), lambda found, k: F.when(found > 0, found).when((k <= F.size(parts)) & reads(k), k).otherwise(0))
        return F.element_at(F.transform(F.array(at), lambda k: F.when(k > 0, F.from_json(rest(k), schema))), 1)

    return F.element_at(F.transform(F.array(F.split(reply, r"\{")), of), 1)


#: Wordings that claim that something is absent.
ABSENCE = r"(?iU)\b(?:no|not any|none|never|nothing|without any|lacks?|does not (?:mention|state|contain|include)|do not (?:mention|state|contain|include)|is not (?:mentioned|stated|given))\b"


def absence_claim(claim: Column) -> Column:
    return claim.rlike(ABSENCE)


def caveat_only(reply: Column, declines, cited: Column, least: int = 120) -> Column:
    """Whether only the last sentence of a reply declines while the head before it is long enough and cited."""
    own = sentences(reply)
    head = F.array_join(F.slice(own, F.lit(1), F.greatest(F.lit(0), F.size(own) - 1)), " ")
    return (F.size(own) > 1) & declines(F.element_at(own, -1)) & ~declines(head) & (F.length(head) >= least) & cited


#: Words of a question that retrieve nothing.
STOP_WORDS = (
    "a an and are as at be been being but by can could did do does doing for from had has have having he her here hers him his how i if in into is it its of on or our out she should so some such than "
    "that the their them then there these they this those through to under until up very was we were what when where which who whom why will with would you your about after again against all also am any "
    "because before below between both during each few further itself just more most no nor not now only other over same too"
).split()


def content_terms(text: Column) -> Column:
    """Distinct words without stop words, the longest first, then by the alphabet."""
    order = F.array_sort(F.transform(F.array_except(tokens(text), F.array(*[F.lit(w) for w in STOP_WORDS])), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.transform(order, lambda x: x["w"])


def promoted_heading(line: Column, before_blank: Column, after_blank: Column, first_content: Column) -> Column:
    """A plain line that stands for a heading, or null: between blank lines, a chapter mark or roman figure, or a short title.

    A title does not head a document, is no list item or quotation, and ends with no mark of a sentence.
    """
    s = F.btrim(line)
    s = F.when(s.rlike(r"^=.+=$"), F.btrim(F.regexp_replace(s, "^=|=$", ""))).otherwise(s)
    chapter = s.rlike(r"^(?:CHAPTER|Chapter|CAPÍTULO|Capítulo|CHAPITRE|Chapitre|Kapitel|KAPANATA|Kabanata)\s+(?:[0-9]+|[IVXLCDM]+|[ivxlcdm]+|primero|Primero)\b.{0,70}$")
    chapter = chapter | s.rlike(r"^第[0-9０-９一二三四五六七八九十百千萬零〇两兩]+[回章].{0,60}$") | s.rlike(r"^(?:[IVXLCDM]+|[ivxlcdm]+)[.:=]?$")
    meta = s.rlike(r"^(?:Author|Title|Language|Credits|Translator|Posting [Dd]ate|Release [Dd]ate|Last [Uu]pdated|Other information|ISBN|Editor)\s*:")
    short = (F.length(s) <= 60) & (F.size(F.split(s, r"\s+")) <= 12) & ~line.rlike(r"^\s") & ~s.rlike(r"""^[-*>|~`\["'“”「『(〔]|["'”’」』)】〔.!?…:;,。！？；：]$|\||^\d+[.)]\s""") & (s != F.lower(s)) & s.rlike(r"[\p{L}\p{N}_]")
    ok = before_blank & after_blank & (s != "") & (F.length(s) <= 80) & ~meta & (chapter | (~first_content & short))
    return F.when(ok, s)


def notes(texts: Column, most: int = 5, chars: int = 500) -> Column:
    """The first texts of a list, cut and parted by blank lines."""
    return F.array_join(F.transform(F.slice(texts, 1, most), lambda t: F.substring(t, 1, chars)), "\n\n")


def abstain_summary(names: Column, locations: Column) -> Column:
    """What a decline says it looked at: up to four names and three places in them, each once."""
    return F.concat_ws("; ", F.array_join(F.slice(F.array_distinct(names), 1, 4), ", "), F.array_join(F.slice(F.array_distinct(locations), 1, 3), ", "))


def longest_prefix(text: Column, tokens_most: int, per_token: int = 4) -> Column:
    """The longest beginning of a text whose tokens, of ``per_token`` signs each, are within the limit."""
    return F.substring(text, 1, tokens_most * per_token)


def summary_reply(reply: Column, wanted: Column, most: int = 32, chars: int = 6000) -> Column:
    """The summaries of a JSON reply by section, or null unless every wanted section is there; each is cut to ``chars``."""
    got = F.from_json(reply, "map<string,string>")
    whole = got.isNotNull() & (F.size(wanted) <= most) & F.forall(wanted, lambda k: F.coalesce(F.length(F.btrim(F.try_element_at(got, k))) > 0, F.lit(False)))
    return F.when(whole, F.transform_values(got, lambda k, v: F.substring(v, 1, chars)))


def starter_questions(reply: Column) -> Column:
    """Three questions of a JSON list, none over 200 signs, or null."""
    got = F.transform(F.from_json(reply, "array<string>"), lambda q: F.btrim(q))
    return F.when((F.size(got) == 3) & F.forall(got, lambda q: (q != "") & (F.length(q) <= 200)), got)


def without_frame(text: Column, start: str = r"\*\*\* ?START OF[^\n]*\*\*\*", end: str = r"\*\*\* ?END OF") -> Column:
    """The part of a book between its start and end lines; the whole text where there are none."""
    body = F.regexp_extract(text, f"(?s){start}\\s*(.*?)\\s*(?:{end}|$)", 1)
    return F.when(text.rlike(start), body).otherwise(text)
