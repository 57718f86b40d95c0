"""Unicode, encodings and text statistics as column expressions."""

from __future__ import annotations

import math
import re
import sys
import unicodedata

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from auditloom.functions.lexicon import CREDENTIALS, FS_TARGETS, PATH_PARTS, SECRET_PARTS, Finder, Kept, codes_of_view, count_near, match_text, plain_view, view_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

# Code points that have no place in a description.
HIDDEN = r"\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{E0000}-\x{E007F}"
ANNOTATION = r"\x{FFF9}-\x{FFFB}"
BIDI = r"\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}"
#: Variation selectors count from the fourth of a run on.
SELECTOR_RUN = r"[\x{FE00}-\x{FE0F}]{4,}"
BASE64 = r"\b[A-Za-z0-9+/]{40,}={0,2}\b"
HEX = r"\b[0-9a-fA-F]{32,}\b"
PERCENT = r"(?:%[0-9a-fA-F]{2}){6,}"
#: Cyrillic and Greek letters that look like Latin ones.
CONFUSABLE = "аеорсхуіјѕһвАЕОРСХУІЈЅНВКМТαεορνικτχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
#: Accented letters and function words that mark French.
FRENCH_LETTERS = "àâäéèêëîïôöùûüÿçœæÀÂÄÉÈÊËÎÏÔÖÙÛÜŸÇŒÆ"
FRENCH = ("le", "la", "les", "des", "une", "un", "du", "pour", "avec", "sans", "vous", "votre", "vos", "ne", "pas", "jamais", "toujours", "avant", "après", "numéro", "fichier", "doit", "doivent", "cette", "est", "sont", "dans", "aux")


#: Combining marks, for ``str.translate``; the table goes to the executors with the function.
COMBINING = dict.fromkeys(c for c in range(0x300, 0x1E950) if unicodedata.combining(chr(c)))
_NOT_ASCII = re.compile(r"[^\x00-\x7f]+")
_folded_runs = Kept(lambda run: unicodedata.normalize("NFKD", run).translate(COMBINING))


def fold_text(text: str | None) -> str:
    if not text or text.isascii():
        return text or ""
    return _NOT_ASCII.sub(lambda run: _folded_runs[run[0]], text)  # ASCII neither changes nor takes part in what stands beside it


#: Characters of a text below which numpy takes longer.
SHORT = 256


def entropy_of(text: str | None) -> float:
    """Shannon entropy of the code points in bits; 0 for the empty text."""
    if not text:
        return 0.0
    if len(text) < SHORT:
        counts = [n for c in sorted(set(text)) if (n := text.count(c)) > 1]
        return math.log2(len(text)) - sum(n * math.log2(n) for n in counts) / len(text)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    counts = np.bincount(points) if points.max() < 1 << 16 else np.unique(points, return_counts=True)[1]
    counts = counts[counts > 1]
    return float(np.log2(len(points)) - (counts * np.log2(counts)).sum() / len(points))


@F.pandas_udf(StringType())
def folded(texts: pd.Series) -> pd.Series:
    """NFKD without combining marks; Spark has no function for it."""
    return texts.map(fold_text)


@F.pandas_udf(StructType([StructField("entropy", DoubleType()), StructField("view", StringType()), StructField("codes", StringType())]))
def profile(texts: pd.Series) -> pd.DataFrame:
    """Entropy of the code points, plain view and codes of the folded text: what Spark has no (fast) function for, in one pass."""
    views = texts.map(lambda t: view_of(fold_text(t)))
    return pd.DataFrame({"entropy": texts.map(entropy_of).astype("float64"), "view": views, "codes": views.map(codes_of_view)})


#: Rules that ``measured`` counts, those of which it gives the first match, and the other fields of what it gives.
COUNTED = ("injection_markers", "concealment", "exfiltration", "hidden_recipient", "email_target", "collector_url", "urgency", "redaction_language", "imperatives", "cross_tool", "directive")
MATCHED = ("cross_server_claim", "model_directed")
MEASURES = StructType(
    [StructField("entropy", DoubleType()), *(StructField(n, IntegerType()) for n in ("words", "non_ascii", "credentials", "fs_targets", *COUNTED)), *(StructField(n, StringType()) for n in MATCHED)]
    + [StructField(n, BooleanType()) for n in ("odd", "foreign", "runs", "marks")]
)
#: White space of Unicode; ``str.split`` takes these four characters for such too.
_SPACE, _NO_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"), "\x1c\x1d\x1e\x1f"
#: What has to be there for hidden characters, for mixed scripts, for encoded runs (in a word of so many characters).
_ODD = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), HIDDEN + ANNOTATION) + "\ufe00-\ufe0f]")
_FOREIGN = re.compile("[\u0370-\u1fff\u2070-\U0010ffff]")
_RUN, RUN_LENGTH = re.compile("[A-Za-z0-9+/]{32}|(?:%[0-9a-fA-F]{2}){6}"), 18


class Measurer:
    """What is counted in a text, and whether a closer look for rare characters can find any."""

    def __init__(self):
        self.finder = Finder((*COUNTED, *MATCHED))
        self.secrets, self.paths = re.compile(CREDENTIALS), re.compile(FS_TARGETS)
        self.empty = self.row("")

    def row(self, text: str) -> tuple:
        """The fields of ``MEASURES``."""
        view = view_of(fold_text(text))
        codes, words, plain = codes_of_view(view), text.split(), text.isascii()
        n_words = sum(map(bool, _SPACE.split(text))) if any(c in text for c in _NO_SPACE) else len(words)
        counts = self.finder.counts(codes)
        matched = (match_text(view, codes, name) if n else None for name, n in zip(MATCHED, counts[len(COUNTED) :], strict=True))
        runs = bool(words) and max(map(len, words)) >= RUN_LENGTH and any(_RUN.search(w) for w in words if len(w) >= RUN_LENGTH)
        return (
            entropy_of(text), n_words, 0 if plain else len(text) - len(text.encode("ascii", "ignore")), count_near(view, SECRET_PARTS, self.secrets), count_near(view, PATH_PARTS, self.paths),
            *counts[: len(COUNTED)], *matched, not plain and bool(_ODD.search(text)), not plain and bool(_FOREIGN.search(text)), runs, "<" in text or "[" in text or "&#" in text,
        )


_measurer: Measurer | None = None


@F.pandas_udf(MEASURES)
def measured(texts: pd.Series) -> pd.DataFrame:
    """Entropy and counts of texts in one pass, without handing on their views and codes; null is as the empty text."""
    global _measurer
    _measurer = measurer = _measurer or Measurer()
    return pd.DataFrame([measurer.row(t) if t else measurer.empty for t in texts], columns=MEASURES.names)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole).otherwise(F.lit(0.0))


def non_ascii_ratio(text: Column) -> Column:
    return ratio(F.length(F.regexp_replace(text, r"[\x00-\x7F]", "")), F.length(text))


def hidden_count(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit(SELECTOR_RUN), F.lit(0))
    return F.regexp_count(text, F.lit(f"[{HIDDEN}{ANNOTATION}]")) + F.aggregate(runs, F.lit(0), lambda a, r: a + F.length(r) - 3)


def hidden_points(text: Column) -> Column:
    """Sorted distinct ``U+XXXX`` of the hidden characters that the detector reports."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"[{HIDDEN}]"), F.lit(0)))
    return F.array_sort(F.transform(found, lambda c: F.concat(F.lit("U+"), F.hex(F.ascii(c).cast("long")))))


def hidden_total(text: Column) -> Column:
    """How many of the hidden characters that the detector reports there are."""
    return F.regexp_count(text, F.lit(f"[{HIDDEN}]"))


def tag_text(text: Column) -> Column:
    """What tag characters (U+E0020 to U+E007E) spell in ASCII."""
    tags = "".join(chr(0xE0000 + i) for i in range(0x20, 0x7F))
    only = F.array_join(F.regexp_extract_all(text, F.lit(r"[\x{E0020}-\x{E007E}]"), F.lit(0)), "")
    return F.translate(only, tags, "".join(chr(i) for i in range(0x20, 0x7F)))


def base64_blobs(text: Column) -> Column:
    """Candidates that could carry a payload: one slash at most, an upper-case letter and a digit."""
    slashes = lambda b: F.length(b) - F.length(F.replace(b, F.lit("/"), F.lit("")))
    return F.filter(F.regexp_extract_all(text, F.lit(BASE64), F.lit(0)), lambda b: (slashes(b) <= 1) & b.rlike("[A-Z]") & b.rlike("[0-9]"))


def blob_count(text: Column) -> Column:
    return F.size(base64_blobs(text)) + F.regexp_count(text, F.lit(HEX)) + F.regexp_count(text, F.lit(PERCENT))


def printable_ratio(text: Column) -> Column:
    return ratio(F.regexp_count(text, F.lit(r"[^\p{C}\p{Z}]|[\n\t ]")), F.length(text))


def decode_candidates(text: Column, blobs: int = 5, runs: int = 3) -> Column:
    """Up to five decoded base64 blobs that are mostly printable, then up to three percent runs."""
    filled = lambda b: F.concat(F.rtrim(b, F.lit("=")), F.repeat(F.lit("="), F.pmod(-F.length(F.rtrim(b, F.lit("="))), F.lit(4))))
    plain = lambda b: F.replace(F.make_valid_utf8(F.try_to_binary(filled(b), F.lit("base64")).cast("string")), F.lit("�"), F.lit(""))
    decoded = F.filter(F.transform(F.slice(base64_blobs(text), 1, blobs), plain), lambda d: d.isNotNull() & (printable_ratio(d) > 0.8))
    percent = F.slice(F.regexp_extract_all(text, F.lit(PERCENT), F.lit(0)), 1, runs)
    return F.concat(decoded, F.filter(F.transform(percent, lambda p: F.try_url_decode(p)), lambda d: d.isNotNull()))


def mixed_words(text: Column) -> Column:
    """Words with a Latin letter and a Cyrillic or Greek one (full-width forms aside)."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0)), lambda w: w.rlike(r"[\p{IsLatin}&&\p{L}&&[^\x{FF21}-\x{FF5A}]]") & w.rlike(r"[\p{IsCyrillic}\p{IsGreek}&&\p{L}]"))


def confusables(text: Column) -> Column:
    """Sorted distinct look-alikes within mixed words."""
    chars = F.flatten(F.transform(mixed_words(text), lambda w: F.regexp_extract_all(w, F.lit(f"[{CONFUSABLE}]"), F.lit(0))))
    return F.array_sort(F.array_distinct(chars))


def homoglyph_ratio(text: Column) -> Column:
    """Letters that are not Latin, of all letters."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return ratio(letters - F.regexp_count(text, F.lit(r"[\p{IsLatin}&&\p{L}]")), letters)


def language_tag(text: Column) -> Column:
    """``fr`` with an accented French letter or three French function words, else ``en``."""
    words = F.regexp_count(plain_view(text), F.lit(rf"\b(?:{'|'.join(FRENCH)})\b"))
    return F.when(text.rlike(f"[{FRENCH_LETTERS}]") | (words >= 3), "fr").otherwise("en")
