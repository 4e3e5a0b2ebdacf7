"""Text expressions. Every function maps Columns to a Column."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these exact patterns and names.
SENTENCE = r"[.!?]*[^.!?\n]+[.!?]*|[.!?]+"
POINT = "\ufdd0"  # a code point no text holds stands for points inside numbers while text is cut
WORD = r"[\p{L}\p{N}]+"
JAMO = r"[\x{3131}-\x{3163}]"
NOT_JAMO = r"[^\x{3131}-\x{3163}]"
LONG_CHUNK = 20
PHONE = r"(\+\d{1,2}\s)?\(?\d{2,3}\)?[\s.-]\d{3,4}[\s.-]\d{4}"
PHONE_MARK = " __PHONE__ "
URL_MARK = " __URL__ "
MOJIBAKE = "í ½"
EMOTICON_MARK = " _emoticon_ "
EMOTICON = r"[\x{2600}-\x{27BF}]|[\x{1F300}-\x{1F64F}]|[\x{1F680}-\x{1F6FF}]"
PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
STAMP_GLUED = r"\[\d{4}-\d{2}-\d{2}\d{2}:\d{2}:\d{2}\]"
STAMP = r"\[[0-9]{4}-[0-9]{2}-[0-9]{2}\s[0-9]{2}:[0-9]{2}:[0-9]{2}\]"
OPEN_CLASSES = ("Noun", "Adverb", "Adjective", "Verb")

# Whitespace as Unicode counts it; a plain \s is ASCII only in Java and in RE2.
UNICODE_SPACE = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# Characters of a link: letters, digits, $ to _, ! and the ellipsis. Those from $ to _
# may also follow one space, as crawled links come apart ("https: //t .co /x").
_URL_CHAR = r"[a-zA-Z$-_!…]"
_URL_SPACED = UNICODE_SPACE + r"[$-_]"
# Possessive loops: one pass and no recursion on links of any length.
URL = (
    rf"https?:{UNICODE_SPACE}?//(?:{_URL_CHAR}|{_URL_SPACED}){_URL_CHAR}*+"
    rf"(?:{_URL_SPACED}{_URL_CHAR}*+)*+"
)

# Surface tokens for tagging: marks and names first, then one script at a time.
LATIN = r"A-Za-z\x{C0}-\x{24F}"
SYLLABLE = r"\x{AC00}-\x{D7A3}"
SURFACE = (
    rf"[#@][\p{{L}}\p{{N}}_]+|[{SYLLABLE}]+|{JAMO}+|[{LATIN}]+|\p{{N}}+|\p{{L}}+|[^\s\p{{L}}\p{{N}}]+"
)
# First matching pattern names the class of a token.
TOKEN_CLASSES = (
    (r"^#.", "Hashtag"),
    (r"^@.", "ScreenName"),
    (rf"^{JAMO}", "KoreanParticle"),
    (r"^\p{N}", "Number"),
    (rf"^[{LATIN}]", "Alpha"),
    (rf"^[{SYLLABLE}]", "Unknown"),
    (r"^\p{L}", "Foreign"),
)


def _latin_folds() -> tuple[str, str]:
    """Accented Latin letters and their base letters, derived from the Unicode tables."""
    accented, base = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        first = unicodedata.normalize("NFD", chr(code))[0]
        if first != chr(code) and first.isascii():
            accented.append(chr(code))
            base.append(first)
    return "".join(accented), "".join(base)


ACCENTED, BASE = _latin_folds()
# Letters and marks that fold to other ASCII text.
LETTER_FOLDS = (
    ("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("ø", "o"), ("Ø", "O"),
    ("ł", "l"), ("Ł", "L"), ("…", "..."), ("–", "-"), ("—", "--"), ("‘", "'"), ("’", "'"),
    ("“", '"'), ("”", '"'), ("¿", "?"), ("¡", "!"), ("«", "<<"), ("»", ">>"),
)


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def strip(text: Column) -> Column:
    """Drop leading and trailing whitespace of any kind (``trim`` drops spaces only)."""
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def lines(text: Column) -> Column:
    """The non-blank lines of a text, in order."""
    return F.filter(F.split(text, "\n"), lambda line: strip(line) != "")


def plain_sentences(text: Column) -> Column:
    """Runs up to and with their closing marks; marks that open a line stay with what follows.

    A point between two digits closes nothing. Twice, because neighbours share their digits.
    """
    joined = text
    for _ in range(2):
        joined = F.regexp_replace(joined, r"([0-9])\.([0-9])", f"$1{POINT}$2")
    return F.transform(extract_all(joined, SENTENCE), lambda s: F.replace(s, F.lit(POINT), F.lit(".")))


def jamo_pieces(line: Column) -> Column:
    """Cut a line at runs of bare jamo; one lone jamo at the very end stays with its text."""
    return extract_all(line, rf"{NOT_JAMO}+{JAMO}?\z|{NOT_JAMO}+|{JAMO}+")


def is_jamo_run(piece: Column) -> Column:
    return piece.rlike(rf"^{JAMO}+$")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def line_sentences(line: Column) -> Column:
    """Sentences of one line.

    A line holding a chunk of more than 20 characters, or one the splitter finds nothing
    in, stays whole. Whitespace around the line goes back to its first and last sentence.
    """
    lead = F.regexp_extract(line, r"^(\s*)", 1)
    tail = F.regexp_extract(line, r"(\s*)\z", 1)
    whole = F.exists(F.split(line, " "), lambda chunk: F.length(chunk) > LONG_CHUNK)

    def framed(cut: Column) -> Column:
        return F.transform(
            cut,
            lambda s, i: F.concat(
                F.when(i == 0, lead).otherwise(""),
                s,
                F.when(i == F.size(cut) - 1, tail).otherwise(""),
            ),
        )

    cut = F.filter(F.transform(plain_sentences(line), strip), lambda s: s != "")
    return F.when(whole, F.array(line)).otherwise(
        bind(cut, lambda c: F.when(F.size(c) == 0, F.array(line)).otherwise(framed(c)))
    )


def text_sentences(text: Column) -> Column:
    """Sentences of a whole text: by line, jamo runs apart, then the sentence cut."""
    pieces = F.flatten(F.transform(lines(text), jamo_pieces))
    return F.flatten(
        F.transform(
            pieces, lambda p: F.when(is_jamo_run(p), F.array(p)).otherwise(line_sentences(p))
        )
    )


def words(sentence: Column) -> Column:
    """Lower-cased words in order; the array index is the word's position."""
    return extract_all(F.lower(sentence), WORD)


def token_class(token: Column) -> Column:
    kind = F
    for pattern, name in TOKEN_CLASSES:
        kind = kind.when(token.rlike(pattern), name)
    return kind.otherwise("Punctuation")


def tagged_words(text: Column) -> Column:
    """Array of ``token_TAG``."""
    return F.transform(
        extract_all(text, SURFACE), lambda t: F.concat(t, F.lit("_"), token_class(t))
    )


def token_of(word: Column) -> Column:
    """``tok_TAG`` without its tag: all before the last underscore."""
    return F.regexp_extract(word, r"^(?s)(.*)_([^_]*)$", 1)


def tag_of(word: Column) -> Column:
    return F.regexp_extract(word, r"^(?s)(.*)_([^_]*)$", 2)


def keep_classes(tagged: Column, classes=OPEN_CLASSES) -> Column:
    return F.filter(tagged, lambda w: tag_of(w).isin(*classes))


def scrub_phone(text: Column) -> Column:
    return F.regexp_replace(text, PHONE, PHONE_MARK)


def scrub_url(text: Column) -> Column:
    return F.regexp_replace(text, URL, URL_MARK)


def scrub(text: Column) -> Column:
    """Phones before links, so that a number inside a link is marked first."""
    return scrub_url(scrub_phone(text))


def fold_ascii(text: Column) -> Column:
    """Latin letters lose their accents, known marks become ASCII, the rest goes."""
    folded = F.translate(text, ACCENTED, BASE)
    for mark, ascii_text in LETTER_FOLDS:
        folded = F.replace(folded, F.lit(mark), F.lit(ascii_text))
    return F.regexp_replace(folded, r"[^\x{00}-\x{7F}]", "")


def normalize(text: Column) -> Column:
    """Punctuation to spaces, emoji to a mark, ASCII fold, single spaces."""
    spaced = F.regexp_replace(text, PUNCTUATION, " ")
    marked = F.regexp_replace(spaced, EMOTICON, EMOTICON_MARK)
    return F.trim(F.regexp_replace(fold_ascii(marked), r"\s+", " "))


def match_key(text: Column) -> Column:
    """Key for aligning texts: no spaces, no time stamps."""
    return F.regexp_replace(F.replace(text, F.lit(" "), F.lit("")), STAMP_GLUED, "")


def distinct_in_order(array: Column) -> Column:
    return F.array_distinct(array)


def stamped_line(ts: Column, text: Column) -> Column:
    return F.format_string("[%s] %s", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), text)
