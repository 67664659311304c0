"""Personal information in free text, found by a skip-chain conditional random field.

Tokens carry features: shapes of addresses and numbers that cover them, captions beside
them, known names and parts of names, titles, and how a capitalised unknown word stands to
these. The field's weights start from stated values and are fitted to the labelled
samples. A word that has any sign of a name is linked with its other mentions in the text,
however far: so an unknown name after a title, which alone is left out (many things are
called "Mr. Something"), is found with the bare mentions that follow it. A text whose
tokens have no feature at all skips the inference if the fitted weights keep every such
chain outside, which is proven once per fit; texts met before by a worker are answered
from its bounded memory.
"""

from __future__ import annotations

import functools
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismgrid.llm.crf import SkipChain
from prismgrid.session import spread

KINDS = ["email", "phone", "id_number", "street_address", "person_name"]
#: The most labelled rows that are fitted to, by least id.
MAX_SAMPLES = 5000
#: Known names are all taken along to the workers; a table of more rows is refused.
MOST_NAMES = 5_000_000
#: Texts a worker remembers; beyond, its memory is emptied.
MEMORY = 200_000
#: Texts inferred together, sorted by length, and their tokens with padding.
BATCH, BATCH_TOKENS = 256, 1 << 16

TOKEN = regex.compile(r"\p{L}[\p{L}\p{M}]*|\p{N}+|[^\s]")
_TOWN = r"(?-i:\p{Lu})[\p{L}'’-]+(?:[ -](?-i:\p{Lu})[\p{L}'’-]+){0,2}"
#: Shapes, each of one kind: fixed values.
SHAPES = {
    "email_sign": ("email", r"[\p{L}\p{N}][\p{L}\p{N}._%+-]*(?:@|＠|\s?(?:\(at\)|\[at\])\s?)(?!\d+x\.)[\p{L}\p{N}-]+(?:(?:\.|\s?(?:\[dot\]|\(dot\))\s?)[\p{L}\p{N}-]+)+"),
    "email_words": ("email", r"[\p{L}\p{N}][\p{L}\p{N}._%+-]* at [\p{L}\p{N}-]+(?: dot [\p{L}\p{N}-]+)+"),
    "phone_plus": ("phone", r"(?<![\p{L}\p{N}])\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d){7,12}(?!\d)"),
    "phone_bracket": ("phone", r"(?<![\p{L}\p{N}+])(?<!\+\d{1,3} )\(0?\d{2,4}\) ?\d{3,4}[ -]\d{3,4}(?!\d)"),
    "phone_exit": ("phone", r"(?<![\p{L}\p{N}])00\d{1,3}(?:[ .-]\d{2,5}){3,5}(?!\d)"),
    "phone_north": ("phone", r"(?<![\p{L}\p{N}.-])\d{3}([.-])\d{3}\1\d{4}(?![\d-])"),
    "phone_trunk": ("phone", r"(?<![\p{L}\p{N}.,-])0(?=(?:[ -]?\d){8,11}(?!\d))\d{1,4}(?:[ -]\d{2,6}){1,4}(?!\d)"),
    "id_three_two_four": ("id_number", r"(?<![\p{L}\p{N}-])\d{3}[- ]\d{2}[- ]\d{4}(?![\d-])"),
    "id_six_four": ("id_number", r"(?<![\p{L}\p{N}-])\d{6}[-+]\d{4}(?![\d-])"),
    "id_dotted": ("id_number", r"(?<![\p{L}\p{N}])\d{3}\.\d{3}\.\d{3}-\d{2}(?!\d)"),
    "id_groups": ("id_number", r"(?<![\p{L}\p{N}+(] )(?<![\p{L}\p{N}+(])\d{2} \d{3} \d{3} \d{3}(?! ?\d)|(?<=[\p{L}:.] )\d{2} \d{3} \d{3} \d{3}(?! ?\d)"),
    "id_insurance": ("id_number", r"(?<![\p{L}\p{N}])\p{L}{2} ?\d{2} ?\d{2} ?\d{2} ?\p{L}(?![\p{L}\p{N}])"),
    "id_passport": ("id_number", r"(?<![\p{L}\p{N}])\p{L}{1,2}\d{7,8}(?![\p{L}\p{N}])"),
    "street_after": ("street_address", rf"(?:(?:apt|flat|unit|suite|apartment|room)\.? \w{{1,5}}, )?(?<![\p{{L}}\p{{N}}.])\d{{1,4}}\p{{L}}?,? (?:(?!(?:to|of|and|in|at|the|or|for|up|on) )[\p{{L}}'’-]+\.? ){{1,4}}?(?:street|st\.|st(?=,| \p{{L}}|$)|road|rd\b\.?|avenue|ave\b\.?|lane|ln\b\.?|close|row|terrace|drive|court|crescent|square|gardens|parade)(?![\p{{L}}\p{{N}}])(?:, {_TOWN}(?: \d{{4,5}})?)?"),
    "street_french": ("street_address", rf"(?<![\p{{L}}\p{{N}}.])\d{{1,4}},?(?: (?:bis|ter|quater))? (?:rue|place|bd|boulevard|avenue|av\.|chemin|impasse|allée|quai|route|cours|passage) [\p{{L}}'’ -]{{2,40}}?(?:, ?\d{{5}} {_TOWN})"),
    "street_before": ("street_address", rf"(?<![\p{{L}}\p{{N}}])(?:[\p{{L}}-]+(?:straße|strasse|str\.|weg|allee|gasse|platz|damm|ufer|steig)|(?:am|im|an der|an den|auf dem|zum|zur) \p{{L}}+(?: \p{{L}}+)?|(?:calle|avenida|plaza|paseo) (?:\p{{L}}+ ){{0,3}}?\p{{L}}+,?) \d{{1,4}}(?: ?\p{{Ll}}(?!\p{{L}}))?(?:, \d{{5}} {_TOWN})"),
}
_SHAPES = [(n, k, regex.compile(p, regex.IGNORECASE)) for n, (k, p) in SHAPES.items()]
#: Words beside a number: fixed values, compared by `near_words`.
CAPTIONS = {
    "caption_id": "ssn sec social ni nino insurance national nat personal citizen identity id passport passeport tax card steuer ausweis",
    "caption_phone": "tel phone telephone call ring callback reachable answers rappeler mobile fax telefon fon",
    "caption_other": "lot ticket part ref sku invoice order batch build version zone page badge ports port serial model item rev",
}
TITLES = "mr mrs ms miss dr prof frau herr mme mlle señor señora sr sra monsieur madame"


def _open(word: str):
    """The word with one letter left open: any of five letters or more, else a vowel."""
    for i, c in enumerate(word):
        if len(word) >= 5 or c in "aeiou":
            yield f"{word[:i]}?{word[i + 1:]}"


def near_words(words: dict[str, str]) -> dict[str, str]:
    """Words with their meaning, also with one letter left open."""
    return {x: m for w, m in words.items() for x in _open(w)} | words


def near(word: str, words: dict[str, str]) -> str:
    """Meaning of a word, or of one that differs in one letter (a vowel, if short); else ''."""
    w = word.casefold()
    if w in words:
        return words[w]
    if 3 <= len(w) <= LONGEST_FIXED:
        for x in _open(w):
            if x in words:
                return words[x]
    return ""


_CAPTIONS = near_words({w: name for name, words in CAPTIONS.items() for w in words.split()})
_TITLES = dict.fromkeys(TITLES.split(), "title")
#: Letters of the longest of the fixed words.
LONGEST_FIXED = max(map(len, [*_CAPTIONS, *_TITLES]))


class Names:
    """Known names, and parts that several of them share, by kind."""

    def __init__(self, known: list[tuple[str, str]]):
        self.memory: dict[str, str] = {}
        self.whole: dict[str, str] = {}
        self.parts = {}
        for kind in ("given", "family"):
            words = sorted({n.casefold() for n, k in known if k == kind and n})
            self.whole.update(dict.fromkeys(words, kind))
            ends = Counter(w[i:] for w in words for i in range(2, len(w) - 2))
            ends = {e for e, n in ends.items() if n >= 3}
            heads = Counter(w[:i] for w in words for i in range(2, len(w) - 2) if w[i:] in ends)
            self.parts[kind] = ({h for h, n in heads.items() if n >= 2}, ends)
        self.measure()

    def measure(self) -> None:
        """Letters of the longest head and end of each kind, which bound the search for parts."""
        self.most = {k: tuple(max(map(len, part), default=0) for part in parts) for k, parts in self.parts.items()}

    def _alike(self, w: str) -> str:
        for kind, (heads, ends) in self.parts.items():
            head, end = self.most[kind]
            for x in (w, w.removesuffix("s")):
                for i in range(max(2, len(x) - end), min(head + 1, len(x) - 2)):
                    if x[:i] in heads and x[i:] in ends:
                        return f"{kind}_like"
        return ""

    def evidence(self, word: str) -> str:
        """'given', 'family', 'given_like', 'family_like' or ''."""
        got = self.memory.get(word)
        if got is None:
            w = word.casefold()
            if w.endswith("s") and w not in self.whole and w[:-1] in self.whole:
                w = w[:-1]
            got = self.whole.get(w, "") or self._alike(w)
            if len(self.memory) > MEMORY:
                self.memory.clear()
            self.memory[word] = got
        return got


FEATURES: list[str] = [
    "token",
    *[f"{n}:{at}" for n in SHAPES for at in "BI"],
    *[f"{c}:{k}" for c in CAPTIONS for k in ("phone", "id_number")],
    "given", "family", "given_like", "family_like", "after_title", "initial_first", "initial_inside",
    "initial_dot", "name_comma", "name_hyphen", "after_name", "title", "short_low",
    "title_unknown", "given_unknown",
]
_ID = {f: i for i, f in enumerate(FEATURES)}
#: Where the weights start: feature -> {label: weight}. The fit is pulled to these values.
START: dict[str, dict[str, float]] = {
    "token": {"B-email": -4, "B-phone": -4, "B-id_number": -4, "B-street_address": -4, "B-person_name": -3,
              "I-email": -2, "I-phone": -2, "I-id_number": -2, "I-street_address": -2, "I-person_name": -3},
    **{f"{n}:B": {f"B-{k}": 8, "O": -1} for n, (k, _) in SHAPES.items()},
    **{f"{n}:I": {f"I-{k}": 6, "O": -1} for n, (k, _) in SHAPES.items()},
    "caption_id:id_number": {"B-id_number": 3, "I-id_number": 1},
    "caption_phone:phone": {"B-phone": 3, "I-phone": 1},
    "caption_id:phone": {"B-phone": -6},
    "caption_phone:id_number": {"B-id_number": -2},
    "caption_other:id_number": {"B-id_number": -12, "I-id_number": -12},
    "caption_other:phone": {"B-phone": -12, "I-phone": -12},
    "given": {"B-person_name": 5, "I-person_name": 4},
    "family": {"B-person_name": 4, "I-person_name": 5},
    "given_like": {"B-person_name": 4.5, "I-person_name": 3.5},
    "family_like": {"B-person_name": 3.5, "I-person_name": 4.5},
    "after_title": {"B-person_name": 1},
    "initial_first": {"B-person_name": 6},
    "initial_inside": {"I-person_name": 5},
    "initial_dot": {"I-person_name": 5},
    "name_comma": {"I-person_name": 6},
    "name_hyphen": {"I-person_name": 6},
    "after_name": {"I-person_name": 1, "B-person_name": -2},
    "title": {"B-person_name": -6, "I-person_name": -6},
    # A short known name in small letters may be an ordinary word.
    "short_low": {"B-person_name": -3, "I-person_name": -1},
    # Capitalised words that are no known names, after a title or a known given name. The
    # first is not enough alone.
    "title_unknown": {"B-person_name": 6},
    "given_unknown": {"I-person_name": 7, "B-person_name": -2},
}
#: Where the weights of agreement start, by kind; the outside has none.
START_AGREE = {"email": 0.5, "phone": 0.5, "id_number": 0.5, "street_address": 0.5, "person_name": 12.0}


def spans(text: str) -> list[tuple[int, int, str, str]]:
    """Places that a shape covers: (start, end, shape, kind); of nested ones the longest."""
    found = []
    for name, kind, pattern in _SHAPES:
        for m in pattern.finditer(text):
            found.append((m.start(), m.end(), name, kind))
    found.sort(key=lambda s: (s[0] - s[1], s[0]))
    kept: list[tuple[int, int, str, str]] = []
    for s in found:
        if not any(s[0] < k[1] and k[0] < s[1] and s[3] != k[3] and k[1] - k[0] > s[1] - s[0] for k in kept):
            kept.append(s)
    return kept


class Tagger:
    """Features, fitted weights and inference for texts."""

    def __init__(self, samples: list[tuple], names: list[tuple[str, str]]):
        self.names = Names(names)
        self.field = SkipChain(KINDS, len(FEATURES))
        for f, weights in START.items():
            for label, w in weights.items():
                self.field.weights[_ID[f], self.field.labels.index(label)] = w
        self.field.agree[1:] = [START_AGREE[k] for k in KINDS]
        self.memory: dict[str, list] = {}
        texts: dict = {}
        for sample, text, kind, start, end in samples:
            if text:
                texts.setdefault((sample, text), []).append((kind, start, end))
        features, edges, labels = [], [], []
        for (_, text), items in texts.items():
            tokens, got, links = self.read(text)
            if not tokens:
                continue
            y = np.zeros(len(tokens), np.int64)
            for kind, start, end in items:
                if kind in KINDS and start is not None and end is not None:
                    at = [i for i, (a, b) in enumerate(tokens) if a < end and b > start]
                    y[at] = self.field.labels.index(f"I-{kind}")
                    y[at[:1]] = self.field.labels.index(f"B-{kind}")
            edges += [(len(features), a, b) for a, b in links]
            features.append(got)
            labels.append(y.tolist())
        if features:
            self.field.fit(features, np.array(edges, np.int64).reshape(-1, 3), labels)
        #: Whether texts without any feature are all outside, as the weights are.
        self.quiet = self.field.stays_outside(self.field.weights[_ID["token"]])

    def read(self, text: str):
        """Tokens, their features and skip edges."""
        matches = list(TOKEN.finditer(text))
        tokens = [m.span() for m in matches]
        words = [m.group() for m in matches]
        n = len(words)
        low = [w.casefold() for w in words]
        evidence = [self.names.evidence(w) if w[0].isalpha() else "" for w in words]
        out = [[0] for _ in words]
        covered = spans(text)
        starts = [a for a, _ in tokens]
        in_email, in_shape = set(), set()
        for a, b, name, kind in covered:
            first = np.searchsorted(starts, a, "right") - 1
            last = np.searchsorted(starts, b, "left")
            caption = None
            if kind in ("phone", "id_number"):
                seen = [c for w in words[max(0, first - 5) : first] if (c := near(w, _CAPTIONS))]
                after = [near(w, _CAPTIONS) for w in words[last : last + 3]]
                caption = seen[-1] if seen else "caption_other" if "caption_other" in after else None
            for i in range(first, last):
                out[i].append(_ID[f"{name}:{'B' if i == first else 'I'}"])
                if caption:
                    out[i].append(_ID[f"{caption}:{kind}"])
                in_shape.add(i)
                if kind == "email":
                    in_email.add(i)
        namey = [e if i not in in_email else "" for i, e in enumerate(evidence)]
        single = [len(w) == 1 and w.isalpha() and i + 1 < n and words[i + 1] == "." and tokens[i + 1][0] == tokens[i][1] for i, w in enumerate(words)]

        def title(i: int) -> bool:
            if low[i] in _TITLES:
                return True
            # A lone M. is a title before a given name or an initial.
            full = i + 2 < n and (namey[i + 2].startswith("given") or single[i + 2])
            before = i and (namey[i - 1] or (i > 1 and low[i - 1] == "." and single[i - 2] and low[i - 2] != "m"))
            return low[i] == "m" and single[i] and not before and full

        titles = [title(i) for i in range(n)]
        for i in range(n):
            if titles[i]:
                out[i].append(_ID["title"])
            before = i - 2 if i and words[i - 1] == "." else i - 1
            if namey[i]:
                out[i].append(_ID[namey[i]])
                if before >= 0 and titles[before]:
                    out[i].append(_ID["after_title"])
                if i and namey[i - 1]:
                    out[i].append(_ID["after_name"])
            elif single[i] and not titles[i]:
                if i and namey[i - 1]:
                    out[i].append(_ID["initial_inside"])
                elif i + 2 < n and (namey[i + 2] or (single[i + 2] and i + 4 < n and namey[i + 4])):
                    out[i].append(_ID["initial_first"])
            elif words[i] == "." and i and single[i - 1] and not titles[i - 1]:
                if (i > 1 and namey[i - 2]) or (i + 1 < n and (namey[i + 1] or single[i + 1])):
                    out[i].append(_ID["initial_dot"])
            elif words[i] == "," and 0 < i < n - 1 and namey[i - 1].startswith("family") and namey[i + 1].startswith("given"):
                alone = i < 2 or not (namey[i - 2] or words[i - 2] in "-.") or titles[i - 2]
                joined = i >= 4 and words[i - 2] == "-" and namey[i - 3] and not namey[i - 4] and words[i - 4] != "."
                joined = joined or (i == 3 and words[1] == "-" and bool(namey[0]))
                dotted = i > 2 and words[i - 2] == "." and (titles[i - 3] or not single[i - 3])
                if alone or joined or dotted:
                    out[i].append(_ID["name_comma"])
                    out[i + 1].append(_ID["after_name"])
            elif words[i] == "-" and 0 < i < n - 1 and namey[i - 1] and namey[i + 1] and tokens[i + 1][0] == tokens[i][1]:
                out[i].append(_ID["name_hyphen"])
            if namey[i] and len(words[i]) <= 3 and not words[i][0].isupper():
                out[i].append(_ID["short_low"])
        signs = {i for i in range(n) if namey[i] and i not in in_shape}
        # Capital letters say something only where most words have none.
        small = sum(w[0].islower() for w in words if len(w) > 2 and w[0].isalpha())
        plain = [len(w) > 1 and w[0].isupper() and w[1:].islower() and not namey[i] and i not in in_shape for i, w in enumerate(words)]
        if 2 * small < sum(len(w) > 2 and w[0].isalpha() for w in words):
            plain = [False] * n
        for i in np.flatnonzero(plain).tolist():
            before = i - 2 if i and words[i - 1] == "." else i - 1
            if before >= 0 and titles[before] and words[before][0].isupper():
                out[i].append(_ID["title_unknown"])
            elif i and namey[i - 1] == "given" and i - 1 not in in_shape:
                out[i].append(_ID["given_unknown"])
            else:
                continue
            signs.add(i)
        # Every other mention is linked with the first that has a sign of a name.
        links, hub = [], {}
        for i in sorted(signs):
            hub.setdefault(low[i].removesuffix("s"), i)
        if hub:
            for i, w in enumerate(low):
                first = hub.get(w.removesuffix("s"), i)
                if first != i and i not in in_shape and (namey[i] or plain[i]):
                    links.append((min(first, i), max(first, i)))
        return tokens, out, links

    def find(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Items of each text as (start, end, kind)."""
        if len(self.memory) > MEMORY:
            self.memory.clear()
        waiting = []
        for text in dict.fromkeys(texts):
            if text not in self.memory:
                self.memory[text] = []
                tokens, features, links = self.read(text)
                if tokens and not (self.quiet and all(len(f) == 1 for f in features)):
                    waiting.append((text, tokens, features, links))
        waiting.sort(key=lambda w: len(w[1]))
        begin = 0
        while begin < len(waiting):
            end = begin + 1
            while end < len(waiting) and end - begin < BATCH and (end + 1 - begin) * len(waiting[end][1]) <= BATCH_TOKENS:
                end += 1
            batch, begin = waiting[begin:end], end
            edges = [(k, a, b) for k, w in enumerate(batch) for a, b in w[3]]
            paths = self.field.decode([w[2] for w in batch], np.array(edges, np.int64).reshape(-1, 3))
            for (text, tokens, _, _), path in zip(batch, paths, strict=True):
                items = self.memory[text]
                for (a, b), label in zip(tokens, path.tolist(), strict=True):
                    if label % 2:
                        items.append((a, b, KINDS[label // 2]))
                    elif label:
                        items[-1] = (items[-1][0], b, items[-1][2])
        return [self.memory[t] for t in texts]


@functools.lru_cache(maxsize=2)
def _tagger(key: tuple) -> Tagger:
    return Tagger(*key)


def fit(pii_labels: DataFrame, person_names: DataFrame) -> Tagger:
    """Fit to at most MAX_SAMPLES labelled rows; all names are known, of a table up to MOST_NAMES."""
    samples = pii_labels.orderBy("sample_id", "start_pos").limit(MAX_SAMPLES).select("sample_id", "text", "kind", "start_pos", "end_pos")
    known = person_names.where("name_part is not null").select("name_part", "part_kind").distinct()
    names = known.limit(MOST_NAMES + 1).collect()
    if len(names) > MOST_NAMES:
        raise ValueError(f"person_names holds more than {MOST_NAMES} names")
    return _tagger((tuple(map(tuple, samples.collect())), tuple(sorted((r.name_part, r.part_kind or "") for r in names))))


FIELDS = ("text", "accessible_name")


class _Model:
    """The tagger as workers get it: weights and names, without the driver's memory."""

    def __init__(self, tagger: Tagger):
        self.tagger = tagger

    def __getstate__(self):
        t = self.tagger
        return {"field": t.field, "whole": t.names.whole, "parts": t.names.parts, "quiet": t.quiet}

    def __setstate__(self, state):
        t = Tagger.__new__(Tagger)
        t.names = Names([])
        t.names.whole, t.names.parts = state["whole"], state["parts"]
        t.names.measure()
        t.field, t.memory, t.quiet = state["field"], {}, state["quiet"]
        self.tagger = t


def find_items(elements: DataFrame, tagger: Tagger) -> DataFrame:
    """(element_id, field_name, kind, start_pos, end_pos), one row per item and delivery's text.

    Null and empty fields hold none. Repeated deliveries give their items once; where
    deliveries differ, the items of each stand. Rows without an id are left out.
    Positions count characters from 0. Texts of any length are read whole.
    """
    model = _Model(tagger)

    def find(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows: list[list] = [[], [], [], [], []]
            for f, name in enumerate(FIELDS):
                column = batch.column(f + 1).dictionary_encode()
                texts = column.dictionary.to_pylist()
                found = model.tagger.find(texts)
                hit = np.array([bool(x) for x in found] or [False])
                codes = column.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                for i in np.flatnonzero((codes >= 0) & hit[codes]).tolist():
                    for start, end, kind in found[codes[i]]:
                        for cell, value in zip(rows, (ids[i], name, kind, start, end), strict=True):
                            cell.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(rows, (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)],
                names=["element_id", "field_name", "kind", "start_pos", "end_pos"],
            )

    return (
        spread(elements.where("element_id is not null and (text <> '' or accessible_name <> '')").select("element_id", *FIELDS))
        .mapInArrow(find, "element_id bigint, field_name string, kind string, start_pos int, end_pos int")
        .distinct()
    )


def redact_fields(elements: DataFrame, tagger: Tagger) -> DataFrame:
    """(element_id, arrived_at, text, accessible_name) with items replaced by ``<KIND>``.

    Every row gives one row; null stays null and all other text is unchanged.
    """
    model = _Model(tagger)

    def replaced(text: str, items: list) -> str:
        for start, end, kind in reversed(items):
            text = f"{text[:start]}<{kind.upper()}>{text[end:]}"
        return text

    def redact(batches):
        for batch in batches:
            columns = [batch.column(0), batch.column(1)]
            for f in (2, 3):
                column = batch.column(f).dictionary_encode()
                texts = column.dictionary.to_pylist()
                clean = [replaced(t, x) for t, x in zip(texts, model.tagger.find(texts), strict=True)]
                columns.append(pa.array(clean, pa.string()).take(column.indices))
            yield pa.RecordBatch.from_arrays(columns, names=["element_id", "arrived_at", *FIELDS])

    return spread(elements.select("element_id", F.col("arrived_at"), *FIELDS)).mapInArrow(
        redact, "element_id bigint, arrived_at timestamp_ntz, text string, accessible_name string"
    )
