import hashlib
import heapq
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from armwatch.llm import conversation_repair as op
from armwatch.llm.registry import QUERIES

WHITE = " \t\n\x0b\x0c\r"
STEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAMES = {"u": "user", "a": "assistant"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """Least cost first, then least audit: rows are (initial, fault)."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in seen:
            continue
        seen.add((at, state))
        if at == len(rows) and state in ("", "a"):
            return cost, audit
        for role in "ua":
            if (state, role) in STEPS:
                heapq.heappush(heap, (cost + 5, audit + "I", at, role))
        if at < len(rows):
            initial, fault = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if (state, initial) in STEPS:
                    heapq.heappush(heap, (cost + extra, audit + "K", at + 1, initial))
                for role in "ua":
                    if (state, role) in STEPS:
                        heapq.heappush(heap, (cost + extra + 1, audit + "R", at + 1, role))


def plain(rows):
    conversations = defaultdict(list)
    for row in damage(rows):
        conversations[row[0]].append(row)
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(conversations[conv], key=lambda r: (
            r[1] is not None, r[1], r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, marked, count = set(), [], defaultdict(int)
        for _, _, role, text in own:
            last = text.rstrip(WHITE)[-1:]
            fault = ("blank" if not last else "duplicate" if (role, text) in seen
                     else "truncated" if last not in ".!?" else "")
            seen.add((role, text))
            marked.append((role[:1], fault))
            count[fault] += 1
        turns = {r[1] for r in own if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit = cheapest(marked)
        lines, state, rest = [], "", iter(own)
        for edit in audit:
            row = next(rest) if edit != "I" else (None, None, "", "")
            if edit == "D":
                continue
            wanted = "a" if state == "u" else "u"
            role = row[2] if edit == "K" else NAMES[wanted]
            lines.append(f"{role}:{row[3]}")
            state = role[:1]
        initials = "".join(line[0] for line in lines)
        assert re.fullmatch("(s?(ua)+)?", initials)
        out.append((conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal,
                    cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return ordered(out)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))


def found(df):
    return ordered(tuple(r) for r in op.reported(df).collect())


def rows_of(rng, conv, size, texts=("Yes.", "No!", "why?", "cut", "", " \t", "é.", "é")):
    turns = np.sort(rng.integers(0, size + 2, size)).tolist()
    return [(conv, None if rng.random() < .05 else t,
             [None, "", "system", "user", "assistant", "user", "assistant", "tool", "User"][
                 rng.integers(9)], None if rng.random() < .05 else str(rng.choice(texts)))
            for t in turns]


def test_same_as_plain(spark):
    rng = np.random.default_rng(11)
    rows = [r for c in range(250) for r in rows_of(rng, c, int(rng.integers(1, 14)))]
    # long conversations are cut into words; a text with its number is no duplicate
    for conv, size in ((None, 40), (1000, 256), (1001, 257), (1002, 1500), (-7, 700)):
        rows += rows_of(rng, conv, size, [f"w{i}" + ".!?x"[i % 4] for i in range(size)])
    rows += [(1003, 2, "user", "same.")] * 600 + [(1003, 5, "assistant", "end.")]
    rows += [(1004, None, None, None), (1005, 1, "user", "long. " * 200_000)]
    rows += [(1006, t, "user", "") for t in range(600)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows],
                               "conv_id long, turn long, role string, text string, place int, "
                               "audit string")
    assert found(df.repartition(5)) == plain(rows)


def test_whole_table(spark):
    path = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").collect()]
    got = QUERIES["op11_conversation_repair"](spark, path)
    assert ordered(tuple(r) for r in got.collect()) == plain(rows)


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert op.reported(df).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(gone, 0, "user", "Hi.")], df.schema)
    assert found(one) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("seed", range(60))
def test_nodes_against_search(seed):
    rng = np.random.default_rng(seed)
    word = "".join(rng.choice(list("suaoSUAOX"), rng.integers(0, 9)))
    node = op.end_node(op.END)
    for letter in reversed(word):
        node = op.node_before(letter, node)
    rows = [(c.lower(), "blank" if c == "X" else "truncated" if c.isupper() else "")
            for c in word]
    assert node[op.START][:2] == cheapest(rows)
