"""Text quality statistics of each document and a decision by fixed thresholds.

Texts are measured in Arrow batches, whole and without a shuffle. All texts of a slice
are one array of code points; a table gives the classes of each, and running sums give
the counts of documents, lines and words. Patterns run only on lines and texts whose
classes leave room for a match. Two sets of rules are applied to the statistics: published
ones, recorded by name, and our own, which decide the kind and are recorded as reasons.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismgrid.session import spread

#: Published rules: name -> (statistic, what fails, source). Fixed values.
PUBLISHED = {
    "word_count_50_to_100000": "n_words < 50 or n_words > 100000",  # Rae et al. 2021, quality filters
    "mean_word_length_3_to_10": "mean_word_length < 3 or mean_word_length > 10",  # Rae et al. 2021
    "hash_or_ellipsis_per_word_0.1": "mark_word_ratio > 0.1",  # Rae et al. 2021
    "bullet_lines_0.9": "bullet_lines > 0.9",  # Rae et al. 2021
    "ellipsis_lines_0.3": "ellipsis_lines > 0.3",  # Rae et al. 2021
    "alphabetic_words_0.8": "alphabetic_words < 0.8",  # Rae et al. 2021
    "two_stop_words": "stop_words < 2",  # Rae et al. 2021
    "duplicate_lines_0.3": "duplicate_lines > 0.3",  # Rae et al. 2021, repetition filters
    "duplicate_line_characters_0.2": "duplicate_line_share > 0.2",  # Rae et al. 2021, repetition filters
    "curly_bracket": "curly_brackets > 0",  # Raffel et al. 2020
    "punctuated_lines_0.12": "punctuated_lines <= 0.12",  # Penedo et al. 2024
    "short_lines_0.67": "short_lines >= 0.67",  # Penedo et al. 2024
}
#: The eight words of the published stop word rule.
STOP_WORDS = ("the", "be", "to", "of", "and", "that", "have", "with")
#: Code points measured together, and rows; a longer text is a slice of its own.
SLICE_POINTS, SLICE_ROWS = 1 << 20, 4096
#: The most common words that are taken along; the table is fixed and holds a few hundred.
MOST_COMMON = 1_000_000

#: Fixed thresholds of the rules.
MIN_LETTERS = 0.55
MAX_ENCODED = 0.4
MAX_MARKUP = 0.4
MAX_CODE = 0.10
MAX_DAMAGED = 0.03
MIN_VOWELS = 0.2
MAX_NOISE_SYMBOLS = 0.12
MAX_SYMBOLS = 0.8
MIN_DISTINCT = 0.2
MOST_LINES = 0.5
#: Words of an entry without a mark, its most characters, its share of common words.
BARE_WORDS, BARE_CHARS, BARE_COMMON = 5, 60, 0.41
#: A line of so many words with such a share of common words, or with one and an end mark,
#: is a sentence, no row of cells.
SENTENCE_WORDS, SENTENCE_COMMON = 7, 0.25

_MARK = (
    r"^\s*(?:[-*•·∙–—→⇒+◦▪▫■□‣›»>○●☐☑☒✓✔✗・※◆◇★☆]\s*(?=\S)|\[[ xX✓]?\]\s*|[①-⓿㈠-㉃]\s*"
    r"|[(（]?[0-9０-９]{1,4}(?:\.[0-9]{1,3})*[.)）:、．]\s|[0-9]{1,3}(?:\.[0-9]{1,3})+\s|[(（]?[0-9]{1,3}[)）、]"
    r"|[(（]?[a-zA-Z][.)）]\s|[(（]?[ivxlcIVXLC]{1,6}[.)）]\s|[一二三四五六七八九十]{1,3}[、.．)）]|#[0-9]+\s"
    r"|[A-Z][A-Z0-9]{1,7}[-_#][0-9]+[:.)]?\s|(?i:<li\b|step [0-9]+\b|no\. ?[0-9]+\b|schritt [0-9]+|étape [0-9]+|paso [0-9]+))"
)
_TABLE = (
    r"\S.*\t|\t.*\t|^\s*(?:\|.*\||¦.*¦|│.*│)\s*$| \| .* \| |^[^|{}()]*(?:\|[^|{}()]*){2,}$|¦[^¦]*¦|│[^│]*│"
    r"|(?i:</t[dh]>|^\s*</?(?:table|tr|tbody|thead)\b)"
    r"|^\s*[+|¦│├┌└╔╚╠:=-][-+|¦│┼┬┴═─:= ]{3,}$|\S(?: {3,}\S+.*| {2,}\S.* {2,}\S)"
)
_CSV = r"^(?!\s*[\[{])(?:\"[^\"]*\"|[^,;\"{}\s][^,;\"{}]{0,39}|)(?:[,;](?:\"[^\"]*\"|[^,;\"{}\s][^,;\"{}]{0,39}|)){2,}$"
_ENCODED = r"[A-Za-z0-9+/=_-]{40,}|(?:\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|%[0-9A-Fa-f]{2}|&#x?[0-9a-fA-F]+;)+|(?<![^\s])(?:[0-9a-fA-F]{2}\s){6,}|(.)\1{15,}"
_MARKUP = r"<[^<>]{0,200}>|&[a-zA-Z]{2,8};|&#[0-9]{1,6};|\{\{|\}\}|%[sd]\b|\$\{"
_URL = r"https?://\S+"
_TAG = r"(?i)</?[a-z][^<>]*>"
_CODE = r"[{}\[\]=<>&|;$^~\\]|\":|\",|\(\)|=>"


# ``\s`` means the six ASCII signs in all patterns.
_MARK_RE, _TABLE_RE, _CSV_RE = (re.compile(p, re.ASCII) for p in (_MARK, _TABLE, _CSV))
_ENCODED_RE, _MARKUP_RE, _URL_RE, _CODE_RE, _TAG_RE = (re.compile(p, re.ASCII) for p in (_ENCODED, _MARKUP, _URL, _CODE, _TAG))
_ENTITY_RE = re.compile(_TAG + "|&[a-z]+;", re.ASCII)
_NEW_SENTENCE = regex.compile(r"[.!?]\s+\p{Lu}", regex.ASCII)
#: A line without any of these is no row of cells.
_CELLS = re.compile(r"[\t|¦│<]|  |^\s*[+├┌└╔╚╠:=-]", re.ASCII)
_SPACE = " \t\n\x0b\x0c\r"
_CLOSERS = "\"'”’»)]"
_ENDS = frozenset(".!?。！？…:")

# Classes of code points, as bits.
LETTER, MARK, DIGIT, SPACE, VISIBLE, LATIN, VOWEL, CODE, DAMAGED, EAST, JOINT, BREAK, ENCODED, HEX, TAGGED = (1 << i for i in range(15))
_MEMBERS = {
    SPACE: _SPACE,
    VOWEL: "aeiouyAEIOUYäöüÄÖÜàáâãåæèéêëìíîïòóôõøùúûœýÿÀÁÂÉÈÍÓÚ",
    CODE: "{}[]=<>&|;$^~\\\"(",
    DAMAGED: "".join(map(chr, range(0x80, 0xA0))) + "\ufffdÂÃ¤©\u00ad",
    JOINT: "'’.-",
    BREAK: "\n\r\x0b\x0c\x85\u2028\u2029",
    ENCODED: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-",
    HEX: "0123456789abcdefABCDEF",
    TAGGED: "<&{}%$\\",
}


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Classes and lower case of every code point."""
    # All planes that hold characters; those left out are unassigned or private.
    points = [*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE0200)]
    every = "".join(map(chr, points))
    kinds = list(map(unicodedata.category, every))
    kind_bits = {"L": LETTER | VISIBLE, "M": MARK | VISIBLE, "N": DIGIT | VISIBLE, "Z": 0, "C": 0}
    table = np.zeros(0x110000, np.uint32)
    table[points] = [kind_bits.get(k[0], VISIBLE) for k in kinds]
    for pattern, bit in ((r"\p{Latin}", LATIN), (r"[\p{Han}\p{Hiragana}\p{Katakana}]", EAST)):
        table[[ord(c) for c in regex.findall(pattern, every)]] |= bit
    for bit, signs in _MEMBERS.items():
        table[[ord(c) for c in signs]] |= bit
    lower = np.arange(0x110000, dtype=np.uint64)
    for c, k in zip(every, kinds, strict=True):
        if k in ("Lu", "Lt") and len(low := c.lower()) == 1:
            lower[ord(c)] = ord(low)
    return table, lower


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.multiply.accumulate(np.append(np.uint64(1), np.full(n, x, np.uint64))) for x in (_BASE, _INVERSE))


def _hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of code points."""
    up, down = _powers(1 << max(10, int(len(points)).bit_length()))
    total = np.append(np.uint64(0), np.cumsum((points + np.uint64(1)) * up[: len(points)], dtype=np.uint64))
    h = (total[ends] - total[starts]) * down[starts]
    return h ^ (h >> np.uint64(29))


def _words(core: np.ndarray, joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words: letters and digits, joined by single signs between them."""
    inside = core.copy()
    inside[1:-1] |= joint[1:-1] & core[:-2] & core[2:]
    step = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _longest(flag: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """Whether each text holds a run of at least so many flagged places."""
    step = np.diff(np.concatenate([[0], flag.view(np.int8), [0]]))
    a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    out = np.zeros(len(starts), bool)
    out[np.searchsorted(starts, a[b - a >= least], "right") - 1] = True
    return out


def _covered(pattern: re.Pattern, text: str) -> int:
    return sum(m.end() - m.start() for m in pattern.finditer(text))


def _ratio(part, whole) -> np.ndarray:
    part, whole = np.asarray(part, float), np.asarray(whole, float)
    return np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)


STATISTICS = {
    "n_lines": "int", "n_words": "int", "mean_word_length": "double", "symbol_ratio": "double", "punctuated_lines": "double",
    "common_share": "double", "longer_common_share": "double", "letter_share": "double", "vowel_share": "double",
    "row_lines": "double", "entry_lines": "double", "marked_lines": "double", "encoded_share": "double", "markup_share": "double",
    "code_share": "double", "damaged_share": "double", "distinct_share": "double", "mark_word_ratio": "double",
    "bullet_lines": "double", "ellipsis_lines": "double", "alphabetic_words": "double", "stop_words": "int",
    "duplicate_lines": "double", "duplicate_line_share": "double", "short_lines": "double", "curly_brackets": "int",
}


def measure(texts: list[str], common: np.ndarray) -> dict[str, np.ndarray]:
    """STATISTICS of each text; ``common`` are the sorted hashes of the common words."""
    table, lower = _tables()
    whole = "\n".join(texts) + "\n"
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    cls = table[points]
    n = len(texts)
    length = np.fromiter(map(len, texts), np.int64, n)
    start = np.cumsum(length + 1) - length - 1
    end = start + length

    def running(flag: np.ndarray) -> np.ndarray:
        return np.append(0, np.cumsum(flag, dtype=np.int64))

    def per_text(flag: np.ndarray) -> np.ndarray:
        total = running(flag)
        return total[end] - total[start]

    core, joint = (cls & (LETTER | DIGIT)) > 0, (cls & JOINT) > 0
    low = lower[points]
    dense = length - per_text((cls & SPACE) > 0)
    letters = per_text((cls & (LETTER | MARK)) > 0)
    named = per_text((cls & (LETTER | MARK | DIGIT)) > 0)
    latin, vowels = per_text((cls & LATIN) > 0), per_text((cls & VOWEL) > 0)

    # Words of texts leave out links, those of lines do not.
    linked = [i for i, t in enumerate(texts) if "://" in t]
    free = core
    if linked:
        free = core.copy()
        for i in linked:
            for m in _URL_RE.finditer(texts[i]):
                free[start[i] + m.start() : start[i] + m.end()] = False
    ws, we = _words(free, joint)
    text_of = np.searchsorted(start, ws, "right") - 1
    hashed = _hashes(low, ws, we)

    def is_common(h: np.ndarray, of: np.ndarray) -> np.ndarray:
        return of[np.minimum(np.searchsorted(of, h), len(of) - 1)] == h if len(of) else np.zeros(len(h), bool)

    known = is_common(hashed, common)
    n_words = np.bincount(text_of, minlength=n)
    word_length = np.bincount(text_of, we - ws, n)
    n_common = np.bincount(text_of, known, n)
    n_longer = np.bincount(text_of, known & (we - ws > 1), n)
    alpha = running((cls & LETTER) > 0)
    n_alpha = np.bincount(text_of, alpha[we] > alpha[ws], n)
    stops = is_common(hashed, _known(STOP_WORDS))
    pairs = np.unique(np.stack([text_of[stops].astype(np.uint64), hashed[stops]], 1), axis=0)[:, 0] if stops.any() else np.zeros(0, np.uint64)
    n_stops = np.bincount(pairs.astype(np.int64), minlength=n)

    # Sequences of four words, where there are twelve words or more.
    distinct = np.full(n, np.nan)
    if len(ws) >= 4:
        exact = _hashes(points.astype(np.uint64), ws, we)
        gram = np.zeros(len(ws) - 3, np.uint64)
        for k in range(4):
            gram = gram * np.uint64(_BASE) + exact[k : len(ws) - 3 + k]
        of = text_of[:-3]
        whole_gram = (text_of[3:] == of) & (n_words[of] >= 12)
        of, gram = of[whole_gram], gram[whole_gram]
        order = np.lexsort((gram, of))
        of, gram = of[order], gram[order]
        fresh = np.append(True, (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])) if len(of) else np.zeros(0, bool)
        n_grams = np.bincount(of, minlength=n)
        distinct = np.where(n_grams > 0, _ratio(np.bincount(of, fresh, n), n_grams), np.nan)

    # Lines that are not blank.
    breaks = np.flatnonzero(cls & BREAK)
    ls, le = np.append(0, breaks[:-1] + 1), breaks
    visible = running((cls & VISIBLE) > 0)
    kept = visible[le] > visible[ls]
    ls, le = ls[kept], le[kept]
    line_of = np.searchsorted(start, ls, "right") - 1
    if linked:
        lws, lwe = _words(core, joint)
        line_known = is_common(_hashes(low, lws, lwe), common)
    else:
        lws, line_known = ws, known
    a, b = np.searchsorted(lws, ls), np.searchsorted(lws, le)
    known_upto = running(line_known)
    n_line, n_line_common = b - a, known_upto[b] - known_upto[a]
    east_upto = running((cls & EAST) > 0)
    east = east_upto[le] > east_upto[ls]
    m = len(ls)
    row, mark, bare, ended, dots, short = (np.zeros(m, bool) for _ in range(6))
    lines = [whole[x:y] for x, y in zip(ls.tolist(), le.tolist(), strict=True)]
    busy = n_line_common >= n_line * SENTENCE_COMMON
    for i, (x, words, commons, many, is_east) in enumerate(zip(lines, n_line.tolist(), n_line_common.tolist(), busy.tolist(), east.tolist(), strict=True)):
        bare_end = x.rstrip(_SPACE).rstrip(_CLOSERS)
        ends = bare_end[-1:] in _ENDS if bare_end else False
        ended[i] = ends
        dots[i] = bare_end.endswith(("...", "…"))
        trimmed = x.strip(" ")
        short[i] = len(trimmed) < 30
        sentence = words >= SENTENCE_WORDS and (many or (ends and commons > 0))
        if not sentence:
            row[i] = bool(_CELLS.search(x) and _TABLE_RE.search(x)) or (x.count(",") + x.count(";") >= 2 and bool(_CSV_RE.search(trimmed)))
        mark[i] = _MARK_RE.match(x) is not None
        if 0 < words <= BARE_WORDS and len(x) <= 4 * BARE_CHARS:
            if is_east:
                bare[i] = len(x) <= 30 and not any(c in x for c in "。！？")
            else:
                bare[i] = len(trimmed) <= BARE_CHARS and commons <= words * BARE_COMMON and not _NEW_SENTENCE.search(x)
    count = lambda flag: np.bincount(line_of, flag, n)
    n_lines = np.bincount(line_of, minlength=n)
    line_hash = _hashes(points.astype(np.uint64), ls, le)
    order = np.lexsort((line_hash, line_of))
    again = np.zeros(m, bool)
    if m:
        again[order[1:]] = (line_hash[order][1:] == line_hash[order][:-1]) & (line_of[order][1:] == line_of[order][:-1])

    # Patterns over whole texts, where the classes leave room for them.
    hexes = (cls & HEX) > 0
    blank = (cls & SPACE) > 0
    pair = np.zeros(len(points) + 18, bool)
    pair[: max(0, len(points) - 2)] = hexes[:-2] & hexes[1:-1] & blank[2:]
    six = pair[:-15].copy()
    for k in range(1, 6):
        six[: len(pair) - 15] &= pair[3 * k : len(pair) - 15 + 3 * k]
    encoded = _longest((cls & ENCODED) > 0, start, 40) | _longest(np.append(False, points[1:] == points[:-1]), start, 15)
    encoded[np.searchsorted(start, np.flatnonzero(six[: len(points)]), "right") - 1] = True
    encoded[linked] = True
    tagged, coded = per_text((cls & TAGGED) > 0), per_text((cls & CODE) > 0)
    n_encoded, n_markup, n_code, n_latin, n_vowels = (np.zeros(n) for _ in range(5))
    n_latin[:], n_vowels[:] = latin, vowels
    for i in np.flatnonzero(encoded | (tagged > 0) | (coded > 0)).tolist():
        t = texts[i]
        if encoded[i] or tagged[i]:
            n_encoded[i] = _covered(_ENCODED_RE, _URL_RE.sub("", t) if "://" in t else t)
        if tagged[i]:
            n_markup[i] = _covered(_MARKUP_RE, t)
        if coded[i]:
            n_code[i] = sum(1 for _ in _CODE_RE.finditer(_ENTITY_RE.sub("", t) if tagged[i] else t))
        if "<" in t:
            plain = table[np.frombuffer(_TAG_RE.sub(" ", t).encode("utf-32-le"), np.uint32)]
            n_latin[i], n_vowels[i] = ((plain & LATIN) > 0).sum(), ((plain & VOWEL) > 0).sum()
    signs = per_text(points == ord("#")) + per_text(points == ord("…")) + np.fromiter((t.count("...") for t in texts), np.int64, n)
    curly = per_text((points == ord("{")) | (points == ord("}")))
    return {
        "n_lines": n_lines,
        "n_words": n_words,
        "mean_word_length": _ratio(word_length, n_words),
        "symbol_ratio": _ratio(dense - named, dense),
        "punctuated_lines": _ratio(count(ended), n_lines),
        "common_share": _ratio(n_common, n_words),
        "longer_common_share": _ratio(n_longer, n_words),
        "letter_share": _ratio(letters, dense),
        "vowel_share": np.where((n_latin >= 20) & (4 * n_latin >= 3 * letters), _ratio(n_vowels, n_latin), np.nan),
        "row_lines": _ratio(count(row), n_lines),
        "entry_lines": _ratio(count(~row & (mark | bare)), n_lines),
        "marked_lines": _ratio(count(~row & mark), n_lines),
        "encoded_share": _ratio(n_encoded, length),
        "markup_share": _ratio(n_markup, length),
        "code_share": _ratio(n_code, length),
        "damaged_share": _ratio(per_text((cls & DAMAGED) > 0), length),
        "distinct_share": distinct,
        "mark_word_ratio": _ratio(signs, n_words),
        "bullet_lines": _ratio(count(mark), n_lines),
        "ellipsis_lines": _ratio(count(dots), n_lines),
        "alphabetic_words": _ratio(n_alpha, n_words),
        "stop_words": n_stops,
        "duplicate_lines": _ratio(count(again), n_lines),
        "duplicate_line_share": _ratio(np.bincount(line_of, (le - ls) * again, n), length),
        "short_lines": _ratio(count(short), n_lines),
        "curly_brackets": curly,
    }


@functools.lru_cache(maxsize=4)
def _known(words: tuple[str, ...]) -> np.ndarray:
    """Sorted hashes of lower-case words."""
    if not words:
        return np.zeros(0, np.uint64)
    lower = _tables()[1]
    points = lower[np.frombuffer("\n".join(words).encode("utf-32-le"), np.uint32)]
    sizes = np.array([len(w) for w in words])
    starts = np.cumsum(sizes + 1) - sizes - 1
    return np.unique(_hashes(points, starts, starts + sizes))


def _slices(ids: list, texts: list) -> Iterator[tuple[list, list]]:
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and (size + len(t) > SLICE_POINTS or i - begin >= SLICE_ROWS):
            yield ids[begin:i], texts[begin:i]
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield ids[begin:], texts[begin:]


def text_statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id and the statistics of each text; a null text counts as empty.

    n_words, mean_word_length, symbol_ratio (characters that are neither letters, digits
    nor white space), punctuated_lines (lines ending in sentence punctuation),
    common_share (words among the common words of any language), and the shares that the
    rules use. A share of nothing is 0; vowel_share is null where few letters are Latin,
    distinct_share where there are fewer than twelve words. ``common_words`` is a fixed
    table of a few hundred words; more than MOST_COMMON are refused. Every row gives one
    row; nothing is cut off.
    """
    distinct = common_words.where("word is not null").select(F.lower("word").alias("word")).distinct()
    words = tuple(sorted(r.word for r in distinct.limit(MOST_COMMON + 1).collect()))
    if len(words) > MOST_COMMON:
        raise ValueError(f"common_words holds more than {MOST_COMMON} words")

    def stripe(batches):
        for batch in batches:
            for ids, texts in _slices(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = measure(texts, _known(words))
                cells = [pa.array(ids, pa.int64())]
                for name, kind in STATISTICS.items():
                    integer = kind == "int"
                    cells.append(pa.array(got[name].astype(np.int32 if integer else float), pa.int32() if integer else pa.float64(), from_pandas=True))
                yield pa.RecordBatch.from_arrays(cells, names=["doc_id", *STATISTICS])

    schema = "doc_id bigint, " + ", ".join(f"{n} {k}" for n, k in STATISTICS.items())
    return spread(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).mapInArrow(stripe, schema)


def classify_texts(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """Statistics, the failed rules (``published``, ``reasons``) and the kind of each document.

    ``published`` names the failed rules of PUBLISHED, ``reasons`` those of our own that
    decide the kind.

    Kinds: ``junk`` if a rule of damage fails, else ``table`` or ``list`` if more than
    half of the lines that are not blank are rows of cells or entries, else ``prose``. A
    table has two lines at least, a list three, or two with marks.
    Null, empty and blank texts are prose with no reasons.
    """
    stats = text_statistics(documents, common_words)
    tabular = (F.col("row_lines") > MOST_LINES) & (F.col("n_lines") >= 2)
    listed = (F.col("entry_lines") > MOST_LINES) & ((F.col("n_lines") >= 3) | ((F.col("n_lines") >= 2) & (F.col("marked_lines") > MOST_LINES)))
    shaped = tabular | listed
    rules = {
        "encoded": F.col("encoded_share") > MAX_ENCODED,
        "damaged": F.col("damaged_share") > MAX_DAMAGED,
        "markup": (F.col("markup_share") > MAX_MARKUP) & ~tabular & (F.col("common_share") < 0.15),
        "code": (F.col("code_share") > MAX_CODE) & ~shaped,
        "few_letters": (F.col("letter_share") < MIN_LETTERS) & ~shaped,
        "few_vowels": (F.col("vowel_share") < MIN_VOWELS) & (F.col("longer_common_share") < 0.1),
        "symbols": F.col("symbol_ratio") > MAX_SYMBOLS,
        "noise": (F.col("symbol_ratio") > MAX_NOISE_SYMBOLS)
        & (F.col("longer_common_share") < 0.08)
        & (F.col("vowel_share") < F.when(shaped, 0.3).otherwise(0.5)),
        "repeated": F.col("distinct_share") < MIN_DISTINCT,
        "rows_of_cells": tabular,
        "enumeration": listed & ~tabular,
    }
    junk = [n for n in rules if n not in ("rows_of_cells", "enumeration")]
    failed = F.array_compact(F.array(*[F.when(F.col("n_lines").cast("boolean") & test, F.lit(n)) for n, test in rules.items()]))
    kind = (
        F.when(F.arrays_overlap("reasons", F.array(*map(F.lit, junk))), "junk")
        .when(F.array_contains("reasons", "rows_of_cells"), "table")
        .when(F.array_contains("reasons", "enumeration"), "list")
        .otherwise("prose")
    )
    readable = F.col("n_lines") > 0
    published = F.array_compact(F.array(*[F.when(readable & F.expr(test), F.lit(n)) for n, test in PUBLISHED.items()]))
    return stats.withColumn("published", published).withColumn("reasons", failed).withColumn("kind", kind)
