"""Personal data: exact rules, and a linear-chain conditional random field that adds what they miss.

The field labels the tokens between white space as other, email, ip, card or phone from features of
their word shapes and their neighbours'. It is trained from a small labelled table by gradients of the forward-backward
algorithm and decoded by Viterbi over numpy batches of token runs.
"""

from __future__ import annotations

import ipaddress
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KINDS = ("email", "ip", "card", "phone")
TAGS = ("other", *KINDS)
#: Rows of a labelled table at most; it is collected.
MAX_LABELLED = 50_000

Span = tuple[int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _emails(text: str) -> list[Span]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        # The rule's leftmost match starts with the run of local characters that ends here, as far as no match has taken it.
        start = at
        while start > free and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str | None) -> dict[str, list[Span]]:
    """Leftmost, non-overlapping matches of the rules by kind, in code points; those that fail their test are dropped, not retried."""
    text = text or ""
    part_fits = lambda p: len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
    return {
        "email": _emails(text),
        "ip": [m.span() for m in _IP.finditer(text) if all(map(part_fits, m.group().split(".")))],
        "card": [m.span() for m in _CARD.finditer(text) if 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)],
        "phone": [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15],
    }


# The labelled table: sentences by rule.


def _example(draw: random.Random) -> tuple[str, list[str]]:
    """An entity as its tag and tokens: in half of the cases one that the rules cover, so that its surroundings are learned, else one that they miss."""
    n = lambda k: "".join(draw.choice("0123456789") for _ in range(k))
    word = lambda: "".join(draw.choice("abcdefghijklmnoprstuvwz") for _ in range(draw.randint(3, 8 if draw.random() < 0.9 else 90)))
    kind, covered = draw.choice(KINDS), draw.random() < 0.5
    if kind == "email":
        if covered:
            return kind, [f"{word()}{draw.choice(['', '.', '_'])}{draw.choice(['', n(2)])}@{word()}{draw.choice(['', n(1)])}.{draw.choice(['', 'example.'])}{draw.choice(['com', 'org', 'net', 'de', 'fr'])}"]
        at, dot = draw.choice(["[at]", "(at)", "{at}"]), draw.choice(["[dot]", "(dot)", "{dot}", "."])
        joined = draw.random() < 0.5
        host = f"{word()}{dot}{draw.choice(['com', 'org', 'net', 'de', 'fr'])}" if joined or dot == "." else f"{word()} {dot} com"
        return kind, (f"{word()}{at}{host}" if joined else f"{word()} {at} {host}").split(" ")
    if kind == "ip":
        parts = [str(draw.randrange(256)) for _ in range(4)]
        if covered:
            return kind, [".".join(parts)]
        if draw.random() < 0.5:
            return kind, [":".join(f"{draw.randrange(65536):x}" for _ in range(8))]
        return kind, ["[.]".join(parts)]
    if kind == "card":
        body = draw.choice("456") + n(14)
        number = next(body + d for d in "0123456789" if luhn(body + d))
        if covered and draw.random() < 0.5:
            return kind, [number]
        sign = draw.choice([" ", "-"] if covered else [".", "/", "_"])
        return kind, sign.join(number[k : k + 4] for k in range(0, 16, 4)).split(" ")
    if covered:
        return kind, draw.choice([f"+{n(1)} ({n(3)}) {n(3)}-{n(4)}", f"+{n(2)} {n(3)} {n(7)}", f"+{n(11)}", f"+{n(1)}-{n(3)}-{n(3)}-{n(4)}"]).split(" ")
    return kind, draw.choice([f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"{n(3)}.{n(3)}.{n(4)}", f"00{n(2)} {n(3)} {n(7)}", f"({n(3)}) {n(3)} {n(4)}"]).split(" ")


def _distractor(draw: random.Random) -> str:
    n = lambda k: "".join(draw.choice("0123456789") for _ in range(k))
    h = lambda k: "".join(draw.choice("0123456789abcdef") for _ in range(k))
    return draw.choice([n(draw.randint(1, 20)), f"{n(1)}.{n(1)}.", f"({n(2)})", f"{n(4)}-{n(2)}-{n(2)}", f"{n(2)}:{n(2)}", f"{n(1)},{n(3)}", f"{n(2)}/{n(2)}/{n(4)}", f"password={h(18)}", f'"{h(40)}"', f"AKIA{h(16).upper()}", f"[{n(1)}]", "(see", "note)", f"{n(4)}-{n(4)}", f"v{n(1)}.{n(2)}.{n(1)}", f"{n(3)}.{n(3)}.{n(3)}.{n(3)}.{n(3)}", f"a_{h(4)}", f"https://{h(5)}.example.org/{n(3)}", f"{n(16)}", f"{n(4)} {n(4)}", "a/b", f"{h(4)}:{h(4)}", f"+{n(2)}"])


def labelled_table(spark: SparkSession, sentences: int = 900, seed: int = 7) -> DataFrame:
    """The default training table: sentence, position, token, tag. Words, marks around them and entities side by side are as in documents."""
    draw, rows = random.Random(seed), []
    letters = draw.choice(["abcdeghilmnoprstuy", "abcdeéèghilmnoprstuyñçüß"])
    ends = ["", "", "", "", "", "", ",", ".", "!!", "?", ";", "***", "$$$", "###"]

    def plain() -> str:
        if draw.random() < 0.04:
            return draw.choice(["|", "-", "&", "=", "token", "*"])
        word = "".join(draw.choice(letters) for _ in range(draw.randint(1, 9)))
        return draw.choice([word, word, word, word.capitalize(), word.upper()]) + draw.choice(ends)

    for s in range(sentences):
        letters = draw.choice(["abcdeghilmnoprstuy", "abcdeéèghilmnoprstuyñçüß"])
        tokens = [(plain(), "other") for _ in range(draw.randint(1, 4))]
        for _ in range(draw.randint(0, 2)):
            if draw.random() < 0.5:
                before = None
                while True:
                    tag, entity = _example(draw)
                    if tag != before:
                        before, last = tag, draw.random() < 0.7
                        entity[-1] += draw.choice(ends) if last else ""
                        tokens += [(t, tag) for t in entity]
                        if last:
                            break
            else:
                tokens += [(t, "other") for t in _distractor(draw).split(" ")]
            tokens += [(plain(), "other") for _ in range(draw.randint(1, 4))]
        rows += [(s, k, token, tag) for k, (token, tag) in enumerate(tokens)]
    return spark.createDataFrame(rows, "sentence long, position long, token string, tag string")


# Features


_SHAPES = str.maketrans({**{c: "d" for c in "0123456789"}, **{c: "x" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "X" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}})
#: A token with one of these characters is marked; all others have the one shape "w".
_MARKS = "0123456789@()[]{}+:/_="
_MARK_TABLE = np.zeros(128, bool)
_MARK_TABLE[[ord(c) for c in _MARKS]] = True


def shape(token: str) -> str:
    """Letters, capitals and digits of a whole token as x, X and d, runs of letters as one, of up to four digits as they are, of more as a plus; a run of digits that passes Luhn's test ends in L; ``w`` without a mark."""
    if not any(c in _MARKS for c in token):
        return "w"
    bare = token.rstrip(".,;!?*$#&%")
    drawn = re.sub(r"([Xd])\1{4,}", r"\1+", re.sub(r"x+", "x", bare.translate(_SHAPES)))
    return drawn + "L" if drawn == "d+" and 13 <= len(bare) <= 19 and luhn(bare) else drawn


def _features(shapes: list[str], k: int) -> list[str]:
    at = lambda j: shapes[j] if 0 <= j < len(shapes) else "w"
    s = at(k)
    signs = "".join(sorted(set(re.sub(r"[xXdwL+]", "", s))))
    return [f"s={s}", f"r={re.sub(r'd+', 'd', s)}", f"p={signs}", f"n={min(s.count('d'), 12)}", f"-1={at(k - 1)}", f"+1={at(k + 1)}", f"-1,0={re.sub(r'd+', 'd', at(k - 1))},{s}", f"0,+1={s},{re.sub(r'd+', 'd', at(k + 1))}", f"0,p={signs},{min(s.count('d'), 12)}", "1"]


@dataclass
class Field:
    """Weights of features by tag and of transitions between tags."""

    index: dict[str, int]
    emissions: np.ndarray
    transitions: np.ndarray

    def scores(self, shapes: list[str]) -> np.ndarray:
        """Emission scores of a run of tokens; unknown features count nothing."""
        out = np.zeros((len(shapes), len(TAGS)))
        for k in range(len(shapes)):
            known = [i for f in _features(shapes, k) if (i := self.index.get(f)) is not None]
            out[k] = self.emissions[known].sum(axis=0)
        return out

    def plain_is_certain(self) -> bool:
        """If a token amid unmarked ones is other whatever stands around: no transition can outweigh its score."""
        s = self.scores(["w", "w", "w"])[1]
        return bool(s[0] - s[1:].max() > 2 * (self.transitions.max() - self.transitions.min()))


def viterbi(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Best tags of a padded batch (run, place, tag); runs begin and end next to tokens that are other."""
    runs, most, _ = scores.shape
    best, back = scores[:, 0] + transitions[0], np.zeros(scores.shape, np.int64)
    for k in range(1, most):
        step = best[:, :, None] + transitions[None]
        back[:, k] = step.argmax(axis=1)
        best = np.where((k < lengths)[:, None], step.max(axis=1) + scores[:, k], best)
    tags = np.zeros((runs, most), np.int64)
    tag = (best + transitions[:, 0]).argmax(axis=1)
    for k in reversed(range(most)):
        inside = k < lengths
        tags[inside, k] = tag[inside]
        tag = np.where(inside & (k > 0), back[np.arange(runs), k, tag], tag)
    return tags


def fit(labelled: DataFrame, steps: int = 150, rate: float = 0.6, penalty: float = 1e-4, max_rows: int = MAX_LABELLED) -> Field:
    """Maximises the conditional likelihood of a small labelled table (sentence, position, token, tag), less an L2 penalty."""
    rows = labelled.orderBy("sentence", "position").limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"the labelled table has more than {max_rows} rows")
    sentences: dict[int, list] = {}
    for r in rows:
        sentences.setdefault(r["sentence"], []).append((shape(r["token"]), TAGS.index(r["tag"])))
    groups, index, most = list(sentences.values()), {}, max([1, *map(len, sentences.values())])
    width, lengths = len(_features(["w"], 0)), np.array([len(g) for g in groups])
    ids, gold = np.zeros((len(groups), most, width), np.int64), np.zeros((len(groups), most), np.int64)
    for s, group in enumerate(groups):
        shapes = [x for x, _ in group]
        for k, (_, tag) in enumerate(group):
            ids[s, k] = [index.setdefault(f, len(index)) for f in _features(shapes, k)]
            gold[s, k] = tag
    mask, tags = np.arange(most)[None] < lengths[:, None], len(TAGS)
    emissions, transitions = np.zeros((len(index), tags)), np.zeros((tags, tags))
    onehot = np.eye(tags)[gold] * mask[..., None]
    pairs = np.einsum("ska,skb->ab", onehot[:, :-1], onehot[:, 1:]) + np.outer(np.eye(tags)[0], onehot[:, 0].sum(0))
    last = onehot[np.arange(len(groups)), lengths - 1]
    pairs += np.outer(last.sum(0), np.eye(tags)[0])
    squares, flat = [np.zeros_like(emissions), np.zeros_like(transitions)], ids.ravel()
    for _ in range(steps):
        e = emissions[ids].sum(axis=2)
        # Forward and backward weights; each place is scaled to a sum of 1, which its probabilities don't depend on.
        e, t = np.exp(e - e.max(axis=2, keepdims=True)), np.exp(transitions)
        forward, backward = np.empty_like(e), np.empty_like(e)
        scaled = lambda x: x / x.sum(axis=1, keepdims=True)
        forward[:, 0] = scaled(e[:, 0] * t[0])
        for k in range(1, most):
            forward[:, k] = scaled((forward[:, k - 1] @ t) * e[:, k])
        backward[:, -1] = t[:, 0]
        for k in reversed(range(most - 1)):
            backward[:, k] = np.where(mask[:, k + 1, None], scaled((e[:, k + 1] * backward[:, k + 1]) @ t.T), t[:, 0])
        p = forward * backward
        p = p / p.sum(axis=2, keepdims=True) * mask[..., None]
        expected = np.outer(np.eye(tags)[0], p[:, 0].sum(0)) + np.outer(p[np.arange(len(groups)), lengths - 1].sum(0), np.eye(tags)[0])
        for k in range(1, most):
            here = np.flatnonzero(mask[:, k])
            left, right = forward[here, k - 1], e[here, k] * backward[here, k]
            expected += t * (left.T @ (right / ((left @ t) * right).sum(axis=1, keepdims=True)))
        miss = (onehot - p).reshape(-1, tags)
        gradient = np.stack([np.bincount(flat, np.repeat(miss[:, t], width), len(index)) for t in range(tags)], axis=1)
        for w, g, q in ((emissions, gradient - penalty * len(groups) * emissions, squares[0]), (transitions, pairs - expected - penalty * len(groups) * transitions, squares[1])):
            q += g * g
            w += rate * g / np.sqrt(q + 1e-8)
    return Field(index, emissions, transitions)


# Decoding


_INSIDE = re.compile(r"[0-9A-Za-z+(\[].*[0-9A-Za-z)\]]|[0-9A-Za-z]", re.S)


def _holds(kind: str, text: str) -> bool:
    """The exact check of an added span."""
    digits = _digits(text)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "email":
        return bool(re.fullmatch(r"[\w.%+-]+\s*(?:@|[\[({<]\s*at\s*[\])}>])\s*[\w-]++(\s*([\[({<]\s*dot\s*[\])}>]|\.)\s*[\w-]++)+", text, re.I))
    try:
        ipaddress.ip_address(text.replace("[.]", "."))
        return "." in text or text.count(":") >= 2
    except ValueError:
        return False


def token_bounds(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of the tokens between blanks and the code points 9 to 13, and which of them are marked."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    solid = np.concatenate([[False], ~((codes == 32) | ((codes >= 9) & (codes <= 13))), [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    marks = np.flatnonzero(_MARK_TABLE[np.minimum(codes, 127)] & (codes < 128))
    marked = np.zeros(len(starts), bool)
    if len(marks):
        marked[np.unique(np.searchsorted(starts, marks, side="right") - 1)] = True
    return starts, ends, marked


class Finder:
    """All spans of a text: those of the rules, and those that the field adds apart from them."""

    def __init__(self, field: Field):
        self.field, self.certain, self.seen = field, field.plain_is_certain(), {}

    def _score(self, shapes: tuple[str, ...]) -> np.ndarray:
        if sum(map(len, shapes)) > 400:
            return self.field.scores(list(shapes))
        if shapes not in self.seen:
            if len(self.seen) > 20_000:
                self.seen.clear()
            self.seen[shapes] = self.field.scores(list(shapes))
        return self.seen[shapes]

    def added(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """For each text the field's spans. Tokens two and more from any marked one are other with certainty; the runs between them are decoded."""
        runs = []
        for number, text in enumerate(texts):
            starts, ends, marked = token_bounds(text)
            near = np.zeros(len(starts) + 2, bool)
            if self.certain:
                for shift in (0, 1, 2):
                    near[shift : shift + len(marked)] |= marked
                near = near[1 : len(starts) + 1]
            else:
                near = np.ones(len(starts), bool)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], near.astype(np.int8), [0]])))
            for first, last in zip(edges[::2].tolist(), edges[1::2].tolist()):
                shapes = tuple(shape(text[starts[k] : ends[k]]) if marked[k] else "w" for k in range(first, last))
                runs.append((number, starts[first:last], ends[first:last], shapes))
        found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        runs.sort(key=lambda r: len(r[3]))
        at = 0
        while at < len(runs):
            size = max(1, min(512, 200_000 // len(runs[min(at + 511, len(runs) - 1)][3])))
            part = runs[at : at + size]
            at += len(part)
            lengths = np.array([len(r[3]) for r in part])
            scores = np.zeros((len(part), lengths.max(), len(TAGS)))
            for k, r in enumerate(part):
                scores[k, : lengths[k]] = self._score(r[3])
            tags = viterbi(scores, lengths, self.field.transitions)
            for k in np.flatnonzero(tags.any(axis=1)):
                number, starts, ends, _ = part[k]
                row = tags[k, : lengths[k]]
                edges = np.flatnonzero(np.diff(np.concatenate([[-1], row, [-1]])))
                for first, last in zip(edges[:-1], edges[1:]):
                    if row[first]:
                        inside = _INSIDE.search(texts[number], int(starts[first]), int(ends[last - 1]))
                        if inside and _holds(TAGS[row[first]], inside.group()):
                            found[number].append((TAGS[row[first]], *inside.span()))
        return found

    def spans(self, texts: list[str]) -> list[tuple[dict[str, list[Span]], dict[str, list[Span]]]]:
        """For each text the rules' spans and all spans, by kind and start. An added span that meets one of the rules' is dropped."""
        out = []
        for text, added in zip(texts, self.added(texts)):
            base = base_spans(text)
            every = {kind: list(spans) for kind, spans in base.items()}
            if added:
                taken = np.array(sorted(s for spans in base.values() for s in spans), np.int64).reshape(-1, 2)
                reach = np.maximum.accumulate(taken[:, 1]) if len(taken) else taken[:, 1]
                for kind, start, end in added:
                    before = np.searchsorted(taken[:, 0], end)
                    if not before or reach[before - 1] <= start:
                        every[kind].append((start, end))
                every = {kind: sorted(spans) for kind, spans in every.items()}
            out.append((base, every))
        return out


def find_pii(docs: DataFrame, field: Field) -> DataFrame:
    """All rows and columns of ``docs`` (with text), with base and spans: arrays of kind, start and end (exclusive) in code points.

    They come by kind, then start. Null counts as empty; each row counts for itself. Columns of those names are replaced.
    """
    docs = docs.drop("base", "spans")
    at = docs.columns.index("text")
    kind = "array<struct<kind:string,start:long,end:long>>"
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(f"base {kind}, spans {kind}").fields])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def rows(by_kind: dict[str, list[Span]]) -> list[dict]:
        return [{"kind": k, "start": a, "end": b} for k in KINDS for a, b in by_kind[k]]

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                found = finder.spans([t.as_py() or "" for t in part.column(at)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([rows(b) for b, _ in found], arrow), pa.array([rows(e) for _, e in found], arrow)], names=schema.names)

    return docs.mapInArrow(find, schema)


def redact(found: DataFrame) -> DataFrame:
    """``found`` with each span of its texts replaced by its kind in angle brackets; of spans that overlap, the first to start."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                parts, at = [], 0
                for s in sorted(spans or [], key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], f"<{s['kind']}>"]
                        at = s["end"]
                texts.append(None if text is None else "".join([*parts, text[at:]]))
            k = batch.schema.get_field_index("text")
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, pa.string()))

    return found.mapInArrow(cut, found.schema)


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """The contract's digest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs, fit(labelled_table(spark))).drop("text")
    count = [F.expr(f"CAST(size(filter(base, s -> s.kind = '{k}')) AS LONG)").alias(f"n_{k}") for k in KINDS]
    joined = lambda c: F.expr(f"array_join(transform({c}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")
    return found.select("doc_id", *count, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
