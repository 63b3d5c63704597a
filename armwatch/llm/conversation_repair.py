"""Conversation repair: cheapest edits over a suffix-shared automaton of role and fault signatures.

A row becomes one letter: its role's initial (s, u, a, or o for others), in capitals where it is
truncated, or X where it must go (blank or duplicate). A conversation's letters are cut into words
of at most ``BLOCK``. The distinct words of all conversations, read from the end, are sorted by
ranges, and one scan walks them: words that end alike share the nodes of that end, and each node
holds for every grammar state the cost to go, the first edit of the best audit suffix and that
suffix, computed once (a node at the edge of a range once more). A word that ends a conversation
starts from the accepting states. A conversation of several words takes the costs from every
state to every other of each word (four scans with one free state each), adds them up from its
last word backwards, and then each word is scanned again with the costs behind it.

Grammar of role initials: (s?(ua)+)?. States: 0 nothing yet, 1 after s, 2 after u, 3 after a.
Edits: K keeps a row (0), R gives it the role that the grammar asks for, user or assistant (1),
D deletes it (2), I inserts an empty row (5); a truncated row that stays adds 5. Of equal costs
the audit that is least in ASCII order wins; each edit leads to one state, so the least first edit
is part of the least audit.

Nulls of any column count as one space in digests, roles and texts; a null conv_id is a
conversation like any other, and null turns come first. Rows of one turn are taken by role, then
by a digest of the text; rows equal in all columns are copies of which the first counts. Texts are
read whole. Columns beside conv_id, turn, role and text are not read. A table without rows gives
none. A conversation of any length crosses words as small numbers only, in sorted streams that
hold one word and one text at a time; only its audit and the digest of its repaired text, which is
one sequential hash, are made in a single task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from armwatch.session import stored

#: Rows of one word.
BLOCK = 256
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FAR = 1 << 60
#: The state that a kept initial leads to, by state; and the one that a user or assistant row,
#: whichever the grammar asks for, leads to.
KEPT = [{"s": AFTER_S, "u": AFTER_U}, {"u": AFTER_U}, {"a": AFTER_A}, {"u": AFTER_U}]
ASKED = [AFTER_U, AFTER_U, AFTER_A, AFTER_U]
#: The end of a conversation: its name among the ends of words, and by state the insertions that
#: lead from there to an accepted sequence. Other ends are named by their costs.
END, MENDED = "end", ("", "II", "I", "")
SPACES = " \t\n\x0b\x0c\r"
Node = list[tuple[int, str, int]]   # by state: cost to go, best audit suffix, state behind it


# -- the automaton ---------------------------------------------------------------------------

def end_node(costs: str) -> Node:
    """The node behind a word's last letter: costs by state, -1 where there is no way."""
    if costs == END:
        return [(INSERT * len(suffix), suffix, q) for q, suffix in enumerate(MENDED)]
    return [(FAR if c < 0 else c, "", q) for q, c in enumerate(map(int, costs.split(",")))]


def node_before(letter: str, behind: Node) -> Node:
    """The node of a letter in front of a node. Edits are tried from the least letter on."""
    low = letter.lower()
    extra = TRUNCATED if letter != low and letter != "X" else 0
    best: list[tuple[int, str, int]] = []
    for q in STATES:
        cost, suffix, out = behind[q]
        choice = cost + DELETE, "D" + suffix, out
        if letter != "X":
            kept = KEPT[q].get(low)
            if kept is not None:
                cost, suffix, out = behind[kept]
                if cost + KEEP + extra < choice[0]:
                    choice = cost + KEEP + extra, "K" + suffix, out
            cost, suffix, out = behind[ASKED[q]]
            if cost + REROLE + extra < choice[0]:
                choice = cost + REROLE + extra, "R" + suffix, out
        best.append(choice)
    # an insertion leads to the next state before the same letter; three in a row reach them all
    for _ in range(3):
        for q in STATES:
            cost, suffix, out = best[ASKED[q]]
            if cost + INSERT < best[q][0] or (cost + INSERT == best[q][0]
                                              and "I" + suffix < best[q][1]):
                best[q] = cost + INSERT, "I" + suffix, out
    return [(min(c, FAR), s, q) for c, s, q in best]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words sorted by (end, reversed word): nodes of the end that two words share are kept."""
    end, word, nodes = None, "", []
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for own_end, own in zip(batch.column("end").to_pylist(),
                                batch.column("reversed").to_pylist()):
            if own_end != end:
                end, word, nodes = own_end, "", [end_node(own_end)]
            shared = 0
            for a, b in zip(word, own):
                if a != b:
                    break
                shared += 1
            del nodes[shared + 1:]
            for letter in own[shared:]:
                nodes.append(node_before(letter, nodes[-1]))
            word = own
            costs, audits, outs = zip(*nodes[-1])
            for values, value in zip(out, (own_end, own[::-1], costs, audits, outs)):
                values.append(value)
        yield pa.record_batch(
            [pa.array(out[0], pa.string()), pa.array(out[1], pa.string()),
             pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.list_(pa.string())),
             pa.array(out[4], pa.list_(pa.int32()))],
            names=["end", "word", "costs", "audits", "outs"])


def automaton(words: DataFrame) -> DataFrame:
    """(end, word, costs, audits, outs), each by grammar state, of the distinct (end, word)."""
    keys = ["end", "reversed"]
    distinct = words.select("end", F.reverse("word").alias("reversed")).distinct()
    return (distinct.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(
        _scan, "end string, word string, costs array<long>, audits array<string>, "
               "outs array<int>"))


# -- rows to letters -------------------------------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """The rows with planted damage, chosen by a digest of conversation and turn."""
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = (F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown("text"), "[.!?]", ""))
            .otherwise(shown("text")))
    return (rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(shown("role"))
                        .alias("role"), text.alias("text"), kind.alias("kind"))
            .where("kind <> 0")
            .withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1)))
                                          .otherwise(F.array(F.lit(0)))))
            .drop("kind", "copy"))


def firsts_of(rows: DataFrame) -> DataFrame:
    """One row per conversation, role and text: the turn it is first seen at, and the text.
    Copies meet as partial aggregates."""
    seen = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    return rows.groupBy("conv_id", "role", F.sha2("text", 256).alias("digest")).agg(
        F.min(seen).alias("seen"), F.min("text").alias("text"))


def letter_of() -> Column:
    """The letter of a first row."""
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    return (F.when(F.col("blank"), "X").when(F.col("truncated"), F.upper(initial))
            .otherwise(initial))


def ordered(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """One line per distinct row of a conversation with its copies ``n``, the letter of the first
    copy, its ``place`` in the conversation and what the line before it was. No texts."""
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    lines = rows.groupBy("conv_id", "turn", "role", F.sha2("text", 256).alias("digest")).agg(
        F.count("*").alias("n"), F.min(last == "").alias("blank"),
        F.min(~last.isin(".", "!", "?")).alias("truncated"))
    seen = firsts.select("conv_id", "role", "digest", F.col("seen.turn").alias("first_turn"))
    a, b = lines.alias("a"), seen.alias("b")
    known = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))
                   & (F.col("a.role") == F.col("b.role"))
                   & (F.col("a.digest") == F.col("b.digest"))).select(
        "a.*", F.col("a.turn").eqNullSafe(F.col("b.first_turn")).alias("first"),
        F.left("a.role", F.lit(1)).alias("initial"))
    line = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    before = line.rowsBetween(W.unboundedPreceding, -1)
    return known.select(
        "*", F.when(F.col("first"), letter_of()).otherwise("X").alias("letter"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("place"),
        F.lag("initial").over(line).alias("initial_before"),
        F.lag(F.struct("turn")).over(line).alias("turn_before"))


def faults(lines: DataFrame) -> DataFrame:
    """Counts per conversation of what is wrong with its rows."""
    n, first = F.col("n"), F.col("first").cast("int")
    pair = F.concat("initial_before", "initial")
    new_turn = F.col("turn").isNotNull() & (
        F.col("turn_before").isNull() | F.col("turn_before.turn").isNull()
        | (F.col("turn_before.turn") != F.col("turn")))
    turns = F.max("turn") - F.min("turn") + 1 - F.sum(new_turn.cast("long"))
    # copies of one row stand side by side, which no pair of initials allows
    return lines.groupBy("conv_id").agg(
        F.coalesce(turns, F.lit(0)).cast("long").alias("gaps"),
        F.sum(F.when(F.col("blank"), n).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), n - first).otherwise(0)).alias("duplicate"),
        F.sum((F.col("first") & ~F.col("blank") & F.col("truncated")).cast("long"))
        .alias("truncated"),
        F.sum(n - 1 + (F.col("initial_before").isNotNull()
                       & ~pair.isin("su", "ua", "au")).cast("long")).alias("illegal"),
        F.sum(n).alias("rows"))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines sorted by (conv_id, place) to words (conv_id, block, word, whether there are others);
    copies are X."""
    key, block, parts, size = None, 0, [], 0
    out: tuple[list, ...] = ([], [], [], [])

    def put(others: bool) -> None:
        for values, value in zip(out, (key[0], block, "".join(parts), others)):
            values.append(value)

    for batch in batches:
        for conv, letter, n in zip(*(batch.column(c).to_pylist()
                                     for c in ("conv_id", "letter", "n"))):
            if key is None or key[0] != conv:
                if size:
                    put(block > 0)
                key, block, parts, size = (conv,), 0, [], 0
            left, front = n, letter
            while left:
                if size == BLOCK:
                    put(True)
                    block, parts, size = block + 1, [], 0
                taken = min(left, BLOCK - size)
                parts.append(front + "X" * (taken - len(front)))
                left, size, front = left - taken, size + taken, ""
            if len(out[0]) >= 4096:
                yield _word_batch(out)
        yield _word_batch(out)
    if size:
        put(block > 0)
    yield _word_batch(out)


def _word_batch(out: tuple[list, ...]) -> pa.RecordBatch:
    batch = pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                             pa.array(out[2], pa.string()), pa.array(out[3], pa.bool_())],
                            names=["conv_id", "block", "word", "several"])
    for values in out:
        values.clear()
    return batch


# -- conversations of several words ----------------------------------------------------------

def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words sorted by (conv_id, block from the last): the costs behind each, less the smallest.
    ``ways`` holds the 16 costs of a word from state q to state e."""
    key, behind = None, None
    for batch in batches:
        ends = []
        for conv, ways in zip(batch.column("conv_id").to_pylist(),
                              batch.column("ways").to_pylist()):
            if key is None or key[0] != conv:
                key, behind = (conv,), np.array([INSERT * len(m) for m in MENDED])
                ends.append(END)
            else:
                ends.append(",".join(map(str, behind.tolist())))
            total = np.array(ways).reshape(4, 4) + behind
            behind = total.min(1)
            behind -= behind.min()
        yield pa.record_batch([batch.column("conv_id"), batch.column("block"),
                               pa.array(ends, pa.string())], names=["conv_id", "block", "end"])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words sorted by (conv_id, block) with what the automaton says: the audit of each, and its
    cost without what lies behind it."""
    key, state = None, START
    for batch in batches:
        audits, costs = [], []
        for conv, end, own, audit, outs in zip(*(batch.column(c).to_pylist() for c in (
                "conv_id", "end", "costs", "audits", "outs"))):
            if key is None or key[0] != conv:
                key, state = (conv,), START
            after = outs[state]
            rest = 0 if end == END else int(end.split(",")[after])
            audits.append(audit[state])
            costs.append(own[state] - rest)
            state = after
        yield pa.record_batch([batch.column("conv_id"), batch.column("block"),
                               pa.array(audits, pa.string()), pa.array(costs, pa.int64())],
                              names=["conv_id", "block", "audit", "cost"])


def audited(words: DataFrame) -> DataFrame:
    """(conv_id, block, audit, cost) of every word. Words behind which another comes end with the
    costs of those, the others with the end of a conversation."""
    long = words.where("several").drop("several")
    free_ends = [",".join("0" if e == q else "-1" for q in STATES) for e in STATES]
    free = F.explode(F.array(*map(F.lit, free_ends)))
    ways = automaton(long.select("word", free.alias("end"))).groupBy("word").agg(
        *(F.max(F.when(F.col("end") == costs, F.col("costs"))).alias(f"to{e}")
          for e, costs in enumerate(free_ends)))
    flat = F.array(*(F.col(f"to{e}")[q] for q in STATES for e in STATES))
    behind = (long.join(ways.select("word", flat.alias("ways")), "word")
              .select("conv_id", "block", "ways").repartition("conv_id")
              .sortWithinPartitions("conv_id", F.desc("block"))
              .mapInArrow(_ends, "conv_id long, block long, end string"))
    a, b = long.alias("a"), behind.alias("b")
    ended = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))
                   & (F.col("a.block") == F.col("b.block"))).select("a.*", "b.end")
    whole = words.where("NOT several").drop("several").withColumn("end", F.lit(END))
    everything = whole.unionByName(ended)
    return (everything.join(automaton(everything), ["end", "word"])
            .select("conv_id", "block", "end", "costs", "audits", "outs")
            .repartition("conv_id").sortWithinPartitions("conv_id", "block")
            .mapInArrow(_forward, "conv_id long, block long, audit string, cost long"))


# -- repaired texts --------------------------------------------------------------------------

class Repair:
    """Applies a conversation's audits, word by word, to its first rows as they stream by."""

    def __init__(self, conv: int | None):
        self.conv, self.cost, self.audits, self.state = conv, 0, [], START
        self.sha, self.any, self.audit, self.at, self.row = hashlib.sha256(), False, "", 0, 0

    def line(self, role: str, text: str) -> None:
        self.sha.update((f"\n{role}:" if self.any else f"{role}:").encode())
        self.sha.update(text.encode())
        self.any = True

    def inserted(self) -> None:
        self.state = ASKED[self.state]
        self.line("user" if self.state == AFTER_U else "assistant", "")
        self.at += 1

    def until(self, row: int | None) -> None:
        """Edits before a row of the conversation, or all of this word."""
        while self.at < len(self.audit) and (row is None or self.row < row
                                             or self.audit[self.at] == "I"):
            if self.audit[self.at] == "I":
                self.inserted()
            else:               # rows without a text here are deleted
                self.at, self.row = self.at + 1, self.row + 1

    def word(self, block: int, audit: str, cost: int) -> None:
        self.until(None)
        self.audit, self.at, self.row = audit, 0, block * BLOCK
        self.audits.append(audit)
        self.cost += cost

    def first_row(self, place: int, role: str, text: str) -> None:
        self.until(place)
        edit = self.audit[self.at]
        self.at, self.row = self.at + 1, self.row + 1
        if edit == "K":
            self.state = KEPT[self.state][role[:1]]
            self.line(role, text)
        elif edit == "R":
            self.state = ASKED[self.state]
            self.line("user" if self.state == AFTER_U else "assistant", text)

    def result(self) -> tuple:
        self.until(None)
        return self.conv, self.cost, "".join(self.audits), self.sha.hexdigest()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audits and first rows sorted by (conv_id, place, audits first) to one row a conversation."""
    own: Repair | None = None
    for batch in batches:
        out = []
        for conv, place, role, text, audit, cost in zip(*(batch.column(c).to_pylist() for c in (
                "conv_id", "place", "role", "text", "audit", "cost"))):
            if own is None or own.conv != conv:
                if own is not None:
                    out.append(own.result())
                own = Repair(conv)
            if audit is not None:
                own.word(place // BLOCK, audit, cost)
            else:
                own.first_row(place, role, text)
        yield _repaired_batch(out)
    yield _repaired_batch([own.result()] if own is not None else [])


def _repaired_batch(rows: list[tuple]) -> pa.RecordBatch:
    conv, cost, audit, sha = zip(*rows) if rows else ((),) * 4
    return pa.record_batch(
        [pa.array(conv, pa.int64()), pa.array(cost, pa.int64()), pa.array(audit, pa.string()),
         pa.array(sha, pa.string())], names=["conv_id", "cost", "audit", "repaired_sha256"])


def repaired(rows: DataFrame) -> DataFrame:
    """Per conversation of (conv_id, turn, role, text), nulls of role and text as given: gaps,
    faults, the cost of the cheapest edits, their audit and a digest of the repaired rows."""
    firsts = stored(firsts_of(rows))
    lines = stored(ordered(rows, firsts.drop("text")))
    words = stored(lines.select("conv_id", "place", "letter", "n").repartition("conv_id")
                   .sortWithinPartitions("conv_id", "place")
                   .select("conv_id", "letter", "n")
                   .mapInArrow(_words, "conv_id long, block long, word string, several boolean"))
    audits = audited(words).select(
        "conv_id", (F.col("block") * BLOCK).alias("place"), F.lit("").alias("role"),
        F.lit("").alias("text"), "audit", "cost")
    a, b = lines.where("first AND NOT blank").alias("a"), firsts.alias("b")
    texts = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))
                   & (F.col("a.role") == F.col("b.role"))
                   & (F.col("a.digest") == F.col("b.digest"))).select(
        "a.conv_id", "a.place", "a.role", "b.text", F.lit(None).cast("string").alias("audit"),
        F.lit(None).cast("long").alias("cost"))
    merged = (audits.unionByName(texts).repartition("conv_id")
              .sortWithinPartitions("conv_id", "place", F.col("audit").isNull())
              .mapInArrow(_repaired, "conv_id long, cost long, audit string, "
                                     "repaired_sha256 string"))
    a, b = faults(lines).alias("a"), merged.alias("b")
    return a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))).select(
        "a.*", "b.cost", "b.audit", "b.repaired_sha256")


def reported(rows: DataFrame) -> DataFrame:
    """Every conversation of the table, repaired after the planted damage; one that the damage
    leaves no rows has no faults, no edits and an empty repaired text."""
    every = rows.select("conv_id").distinct()
    a, b = every.alias("a"), repaired(damaged(rows)).alias("b")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    nothing = hashlib.sha256(b"").hexdigest()
    return a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")), "left").select(
        "a.conv_id", *(F.coalesce(f"b.{name}", F.lit(0)).cast("long").alias(name)
                       for name in numbers),
        F.coalesce("b.audit", F.lit("")).alias("audit"),
        F.coalesce("b.repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
