"""Personal data: exact base patterns, and a linear-chain conditional random field beside them.

The field finds what the patterns miss: addresses spelled out or spaced (``name at host dot tld``),
national phone numbers, IPv6 and defanged addresses, cards written with dots or slashes. Its
features are a word's shape, counts and check digit and its lower-case identity, with those of its
neighbours. Sequences are the words within four words of a digit, an at sign or a spelled-out dot;
words elsewhere are outside of any span. It is trained in numpy from a small labelled table
(``pii_labels`` for what the patterns miss, and texts of the corpus in which only base spans count)
and decoded by Viterbi over all sequences of an Arrow batch at once. Its spans are added where they
overlap no base span and are valid for their kind (a card passes its check digit); base spans stay.

Null and empty texts have no spans. Texts are read whole; every pattern takes time in proportion
to the text, whatever it holds. Rows that repeat are read alike; doc_id may be null; other columns
play no part. Of an empty table the result is empty.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armwatch.llm.pii_labels import KINDS, luhn, marked_texts
from armwatch.session import stored

#: Documents of the corpus in the labelled table, and the words that each gives at most. They
#: bound the training only: every text is tagged whole.
LABELLED, WORDS = 300, 1000
#: Outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)

_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping per kind."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        host = _HOST.match(text, at)
        start = at
        while host and start > last and text[start - 1] in _LOCAL:
            start -= 1
        if host and start < at:
            out.append((start, 0, host.end()))
            last = host.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
               for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# ------------------------------------------------------------------------------ the field

#: A spelled-out dot: a word of its own, or in brackets anywhere.
_DOT = re.compile(r"(?i)(?<!\S)dot(?!\S)|[(\[{](?:dot|punkt|punto|point)[)\]}]")
#: Words on either side of a mark that belong to its sequence.
REACH = 4
_LETTERS, _DIGIT = re.compile(r"[^\W\d_]+"), re.compile(r"[0-9]")
_EDGES = ".,;:!?)(\"'|#*$%&<>[]{}"
#: Sizes of the counted features; then come the word's form and identity, by a vocabulary.
SIZES = (8, 2, 3, 5, 2, 2, 4, 4, 3)
_STEPS = (1, 4, 5, 9, 12, 16, 20)
#: Neighbours that each feature is read at: identities reach further than shapes.
OFFSETS = tuple((-1, 0, 1) for _ in SIZES) + ((-1, 0, 1), (-2, -1, 0, 1, 2))


def words_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words that belong to sequences."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    gap = (c == 32) | ((c >= 9) & (c <= 13))
    edge = np.diff(np.r_[1, gap.view(np.int8), 1])
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return starts, ends
    mark = ((c >= 48) & (c <= 57)) | (c == 64)
    for m in _DOT.finditer(text):
        mark[m.start()] = True
    sums = np.r_[0, np.cumsum(mark)]
    marked = sums[ends] > sums[starts]
    near = marked.copy()
    for step in range(1, REACH + 1):
        near[step:] |= marked[:-step]
        near[:-step] |= marked[step:]
    return starts[near], ends[near]


def form(word: str) -> str:
    """The word with runs of letters as ``a`` and digits as ``9``, without outer punctuation."""
    return _DIGIT.sub("9", _LETTERS.sub("a", word.strip(".,;:!?\"'")))[:24]


def identity(word: str) -> str:
    return word.lower().strip(_EDGES) or word[:3]


def counted(word: str) -> tuple[int, ...]:
    digits = _DIGIT.findall(word)
    n = len(digits)
    return (sum(n >= step for step in _STEPS), int(_LETTERS.search(word) is not None),
            ("@" in word) + (word == "@"), min(4, word.count(".")), int(word[:1] == "+"),
            int("(" in word or "[" in word), min(3, word.count("-")), min(3, word.count(":")),
            1 + luhn("".join(digits)) if 12 <= n <= 19 else 0)


def vocabulary(rows: list[list[str]], of) -> dict[str, int]:
    """Numbers from 1 of what two rows or more hold; 0 is for all others."""
    seen: dict[str, int] = {}
    for row in rows:
        for item in {of(word) for word in row}:
            seen[item] = seen.get(item, 0) + 1
    return {item: i + 1 for i, item in enumerate(sorted(k for k, n in seen.items() if n > 1))}


def features(words: list[str], forms: dict[str, int], names: dict[str, int]) -> np.ndarray:
    """A row of feature numbers per word."""
    known: dict[str, tuple[int, ...]] = {}
    for word in words:
        if word not in known:
            known[word] = (*counted(word), forms.get(form(word), 0), names.get(identity(word), 0))
    return np.array([known[word] for word in words], np.int64).reshape(len(words), len(OFFSETS))


def columns_of(own: np.ndarray, first: np.ndarray, sizes: list[int]) -> Iterator[np.ndarray]:
    """The feature numbers at every offset; one past the last number stands for no neighbour."""
    sequence, place = np.cumsum(first), np.arange(len(own))
    for j, (size, offsets) in enumerate(zip(sizes, OFFSETS)):
        for offset in offsets:
            there = np.clip(place + offset, 0, max(0, len(own) - 1))
            same = (there == place + offset) & (sequence[there] == sequence)
            yield np.where(same, own[there, j], size)


def scores_of(own: np.ndarray, first: np.ndarray, field: dict) -> np.ndarray:
    scores = np.zeros((len(own), TAGS))
    for ids, weight in zip(columns_of(own, first, field["sizes"]), field["weights"]):
        scores += weight[ids]
    return scores


def sequences(starts: np.ndarray, ends: np.ndarray, text: str) -> np.ndarray:
    """Whether a word begins a sequence: the words before it are of no sequence."""
    return np.array([i == 0 or not text[ends[i - 1]:starts[i]].isspace()
                     for i in range(len(starts))], bool)


def padded(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(step, sequence) of each word, sequences by falling length."""
    begin = np.flatnonzero(first)
    length = np.diff(np.r_[begin, len(first)])
    rank = np.empty(len(begin), np.int64)
    rank[np.argsort(-length, kind="stable")] = np.arange(len(begin))
    which = np.repeat(np.arange(len(begin)), length)
    return np.arange(len(first)) - begin[which], rank[which]


def viterbi(scores: np.ndarray, first: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best tags of all sequences at once; step by step over those that are long enough."""
    if not len(first):
        return np.zeros(0, np.int64)
    step, seq = padded(first)
    order = np.lexsort((seq, step))
    counts = np.bincount(step)
    begin = np.r_[0, np.cumsum(counts)]
    best, back = scores[order[:counts[0]]].copy(), []
    final = best
    for t in range(1, len(counts)):
        n = counts[t]
        options = best[:n, :, None] + move
        back.append(options.argmax(1).astype(np.int8))
        best = options.max(1) + scores[order[begin[t]:begin[t + 1]]]
        final[:n] = best
    tags = np.zeros(len(first), np.int64)
    now = final.argmax(1)
    for t in range(len(counts) - 1, -1, -1):
        n = counts[t]
        tags[order[begin[t]:begin[t + 1]]] = now[:n]
        if t:
            now[:n] = back[t - 1][np.arange(n), now[:n]]
    return tags


def train(own: np.ndarray, first: np.ndarray, tags: np.ndarray, sizes: list[int],
          steps: int = 80, penalty: float = .02) -> tuple[list[np.ndarray], np.ndarray]:
    """Weights by gradient steps (Adam) on the penalised log-likelihood; the expected counts
    come from the forward and backward sums over all sequences at once."""
    sides = list(columns_of(own, first, sizes))
    rows = [size + 1 for size, offsets in zip(sizes, OFFSETS) for _ in offsets]
    orders = [np.argsort(side, kind="stable") for side in sides]
    begins = [np.flatnonzero(np.diff(side[order], prepend=-1))
              for side, order in zip(sides, orders)]
    step, seq = padded(first)
    long, many = int(step.max()) + 1, int(seq.max()) + 1
    here = np.zeros((long, many), bool)
    here[step, seq] = True
    goal = np.zeros((len(own), TAGS))
    goal[np.arange(len(own)), tags] = 1
    weights = [np.zeros((n, TAGS)) for n in rows] + [np.zeros((TAGS, TAGS))]
    pairs = np.zeros((TAGS, TAGS))
    inner = np.flatnonzero(~first)
    np.add.at(pairs, (tags[inner - 1], tags[inner]), 1)
    means, squares = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]

    def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)

    for i in range(1, steps + 1):
        scores = sum(w[s] for w, s in zip(weights, sides))
        grid = np.zeros((long, many, TAGS))
        grid[step, seq] = scores
        move = weights[-1]
        forward, backward = grid.copy(), np.zeros_like(grid)
        for t in range(1, long):
            forward[t] += log_sum(forward[t - 1][:, :, None] + move, 1)
        for t in range(long - 2, -1, -1):
            ahead = log_sum(move + (grid[t + 1] + backward[t + 1])[:, None, :], 2)
            backward[t] = np.where(here[t + 1][:, None], ahead, 0)
        both = forward + backward
        share = np.exp(both - log_sum(both, 2)[:, :, None])[step, seq]
        expected = np.zeros((TAGS, TAGS))
        for t in range(1, long):
            joint = (forward[t - 1][:, :, None] + move + (grid[t] + backward[t])[:, None, :])
            joint = joint[here[t]]
            top = joint.max((1, 2), keepdims=True)
            joint = np.exp(joint - top)
            expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        gradient, missing = [], goal - share
        for side, order, begin, n in zip(sides, orders, begins, rows):
            gradient.append(np.zeros((n, TAGS)))
            gradient[-1][side[order[begin]]] = np.add.reduceat(missing[order], begin)
        gradient.append(pairs - expected)
        for w, g, m, v in zip(weights, gradient, means, squares):
            g = g / many - penalty * w / 10
            m += .1 * (g - m)
            v += .01 * (g * g - v)
            w += .1 * (m / (1 - .9 ** i)) / (np.sqrt(v / (1 - .99 ** i)) + 1e-6)
    return weights[:-1], weights[-1]


def tagged(starts: np.ndarray, ends: np.ndarray, spans: list) -> np.ndarray:
    """Tags of words from (start, kind, end) spans that they overlap."""
    tags = np.zeros(len(starts), np.int64)
    for start, kind, end in spans:
        inside = np.flatnonzero((starts < end) & (ends > start))
        tags[inside] = 2 + 2 * kind
        tags[inside[:1]] = 1 + 2 * kind
    return tags


def spans_of(starts: np.ndarray, ends: np.ndarray, tags: np.ndarray,
             text: str) -> list[tuple[int, int, int]]:
    """Spans of tagged words, without punctuation at their ends."""
    out: list[tuple[int, int, int]] = []
    for start, end, tag in zip(starts.tolist(), ends.tolist(), tags.tolist()):
        if not tag:
            continue
        kind = (tag - 1) // 2
        if tag % 2 == 0 and out and out[-1][1] == kind and text[out[-1][2]:start].isspace():
            out[-1] = (out[-1][0], kind, end)
        else:
            out.append((start, kind, end))
    trimmed = []
    for start, kind, end in out:
        while end > start and text[end - 1] in ".,;:!?)\"'|#*$%&<>":
            end -= 1
        while start < end and (text[start] in "\"'|#*$%&<>" or text[start].isspace()
                               or text[start:start + 2] == ": "):
            start += 1
        if end > start:
            trimmed.append((start, kind, end))
    return trimmed


def valid(kind: int, text: str) -> bool:
    """Whether a span that the field adds can be of its kind."""
    digits = "".join(_DIGIT.findall(text))
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == 3:
        return 7 <= len(digits) <= 15
    return kind == 0 or len(text) > 5


def training_row(text: str, spans: list, most: int | None = None) -> dict:
    """Words of the text's sequences, where sequences begin, and tags."""
    starts, ends = (edge[:most] for edge in words_of(text))
    return {"words": [text[a:b] for a, b in zip(starts.tolist(), ends.tolist())],
            "first": sequences(starts, ends, text).tolist(),
            "tags": tagged(starts, ends, spans).tolist()}


def labelled_table(docs: DataFrame, n: int = LABELLED, most: int = WORDS) -> DataFrame:
    """Labelled rows (words, first, tags) of n documents with digits or at signs, the first by a
    digest of doc_id. Their base spans are the labels; numbers that fail a check are outside."""
    chosen = stored(docs.where(F.col("text").rlike("[0-9@]")).select(
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_digest"),
        "doc_id").orderBy("_digest").limit(n).select("doc_id").distinct())
    # at most LABELLED rows: small enough to broadcast
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy(
        F.md5(F.col("doc_id").cast("string")), "text").limit(n)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [training_row(text or "", base_spans(text or ""), most)
                    for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([
                ("words", pa.list_(pa.string())), ("first", pa.list_(pa.bool_())),
                ("tags", pa.list_(pa.int64()))]))

    return picked.select("text").mapInArrow(
        label, "words array<string>, first array<boolean>, tags array<long>")


#: Words of one training sequence; longer ones are cut for training, never for decoding.
LONGEST = 40


def fit(labelled: DataFrame, marked: list[tuple[str, list]] | None = None) -> dict:
    """The field of the labelled rows and of marked texts (those of ``pii_labels`` if not given).

    Forms and identities are numbered from rows of both; a word that one row alone holds has none,
    and identities are those of the marked texts, whose words tell what stands beside a span.
    """
    extra = [training_row(text, spans)
             for text, spans in (marked_texts() if marked is None else marked)]
    rows = [r for r in (*(r.asDict() for r in labelled.collect()), *extra) if r["words"]]
    forms = vocabulary([r["words"] for r in rows], form)
    names = vocabulary([r["words"] for r in extra], identity)
    first = np.concatenate([np.array(r["first"], bool) for r in rows])
    place = np.arange(len(first)) - np.maximum.accumulate(
        np.where(first, np.arange(len(first)), 0))
    own = features([word for r in rows for word in r["words"]], forms, names)
    sizes = [*SIZES, len(forms) + 1, len(names) + 1]
    weights, move = train(own, first | (place % LONGEST == 0),
                          np.concatenate([np.array(r["tags"]) for r in rows]), sizes)
    return {"forms": forms, "names": names, "sizes": sizes, "move": move.tolist(),
            "weights": [np.round(w, 5).tolist() for w in weights]}


def held(field: str) -> dict:
    """A field from its JSON form, with arrays."""
    own = json.loads(field)
    return {**own, "move": np.array(own["move"]), "weights": [np.array(w) for w in own["weights"]]}


def found_in(texts: list[str | None], field: dict) -> list[tuple]:
    """(base, all) spans of each text."""
    base = [base_spans(t) if t else [] for t in texts]
    words = [words_of(t or "") for t in texts]
    first = np.concatenate([*(sequences(*w, t or "") for w, t in zip(words, texts)),
                            np.zeros(0, bool)])
    own = features([t[a:b] for t, w in zip(texts, words)
                    for a, b in zip(w[0].tolist(), w[1].tolist())], field["forms"], field["names"])
    tags, out, at = viterbi(scores_of(own, first, field), first, field["move"]), [], 0
    for text, (starts, ends), known in zip(texts, words, base):
        more = spans_of(starts, ends, tags[at:at + len(starts)], text or "")
        at += len(starts)
        taken, i, added = sorted((s, e) for s, _, e in known), 0, []
        reach = 0
        for span in more:
            while i < len(taken) and taken[i][0] < span[2]:
                reach = max(reach, taken[i][1])
                i += 1
            if reach <= span[0] and valid(span[1], text[span[0]:span[2]]):
                added.append(span)
        out.append((known, sorted(known + added)))
    return out


def found(text: Column, field: dict) -> Column:
    """A struct of the base spans and of all spans, each an array of (kind, start, end)."""
    sent = json.dumps(field)
    span = pa.list_(pa.struct({"kind": pa.string(), "start": pa.int32(), "end": pa.int32()}))

    @F.arrow_udf("struct<base: array<struct<kind: string, start: int, `end`: int>>,"
                 "spans: array<struct<kind: string, start: int, `end`: int>>>")
    def spans(texts: pa.Array) -> pa.Array:
        own = held(sent)

        def shown(found_spans: list) -> list[dict]:
            return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in found_spans]

        return pa.array([{"base": shown(b), "spans": shown(a)}
                         for b, a in found_in(texts.to_pylist(), own)],
                        pa.struct({"base": span, "spans": span}))

    # else each expression that reads the spans finds them anew
    return spans.asNondeterministic()(text)


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def reported(docs: DataFrame) -> DataFrame:
    """Per document the number of base spans of each kind, their digest, and all spans."""
    field = fit(labelled_table(docs))
    both = docs.select("doc_id", found(F.col("text"), field).alias("f"))
    return both.select("doc_id", *(
        F.expr(f"size(filter(f.base, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}")
        for k in KINDS), F.sha2(_line(F.col("f.base")), 256).alias("base_sha256"),
        _line(F.col("f.spans")).alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; n_chars, where it
    is a column, follows the text. Null texts stay null."""
    field = json.dumps(fit(labelled_table(docs)))

    @F.arrow_udf("string")
    def mask(texts: pa.Array) -> pa.Array:
        own = held(field)
        rows, out = texts.to_pylist(), []
        for text, (_, spans) in zip(rows, found_in(rows, own)):
            parts, at = [], 0
            for start, kind, end in spans:
                if start >= at:
                    parts += [text[at:start], f"<{KINDS[kind]}>"]
                at = max(at, end)
            out.append(None if text is None else "".join([*parts, text[at:]]))
        return pa.array(out, pa.string())

    clean = docs.withColumn("text", mask.asNondeterministic()("text"))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean
