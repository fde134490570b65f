"""Chat formatting against a plain walk over the trees."""

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from pavemetric.llm import chat, registry

TREE = "conv_id long, msg_id long, parent_id long, role string, text string, score double, branch int, pos string, k_conv long, up long"
TURNS = "conv_id long, turn long, role string, text string, branch int, msg_id long, up long"
HOSTILE = ["", None, "\\", "\\\\", "</turn>", "<turn>", "\\</turn>", "<\\/turn>", "<\\\\turn>\n", "a\nb", "\\n", "</turn", ">", "\U0001f600</turn>é", "\\### Assistant: </turn> ok", "<</turn>turn>"]


def sha(text):
    return sha256(text.encode()).hexdigest()


def digest(conv, turns):
    masked = "".join(t for r, t in turns if r == "assistant")
    return conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(masked), sha(masked)


def plain_paths(rows, branches):
    """Root-to-leaf paths of each conversation, best first."""
    kept = {}
    order = lambda r: (r[2] is not None, r[2] or 0, r[3] or "", r[4] or "", r[5] or 0.0)
    for r in rows:
        if r[1] is not None and ((r[0], r[1]) not in kept or order(r) < order(kept[r[0], r[1]])):
            kept[r[0], r[1]] = r
    above = {k: (k[0], r[2]) if r[2] is not None and r[2] != k[1] and (k[0], r[2]) in kept else None for k, r in kept.items()}
    out = {}
    for leaf in set(kept) - set(above.values()):
        path, node = [], leaf
        while node and len(path) <= len(kept):
            path.append(node)
            node = above[node]
        if not node:
            out.setdefault(leaf[0], []).append(path[::-1])
    mean = lambda p: sum(kept[n][5] or 0.0 for n in p) / len(p)
    best = {c: sorted(ps, key=lambda p: (-mean(p), -len(p), p[-1][1]))[:branches] for c, ps in out.items()}
    return sorted((repr(digest(c, [(kept[n][3] or "", kept[n][4] or "") for n in p])), i) for c, ps in best.items() for i, p in enumerate(ps, 1))


def got(df):
    rows = chat.digests(df).collect()
    return sorted((repr((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256)), r.branch) for r in rows)


@pytest.mark.parametrize("branches", [1, 2, None])
def test_trees(spark, branches):
    rng = random.Random(3)
    rows = []
    for conv in [*range(8), None]:
        for m in range(rng.randint(1, 25)):
            rows.append((conv, m, rng.choice([None, m, 99, *range(m)]), rng.choice(["user", "assistant", "system", None, "a\nb</turn>"]), rng.choice(HOSTILE), rng.choice([None, 0.25, 0.5, 1.0])))
    rows += [(20, m, m - 1 if m else None, "user", str(m), 0.0) for m in range(70)]  # a long chain
    rows += [(21, 1, 2, "user", "circle", 1.0), (21, 2, 1, "user", "circle", 1.0), (21, 3, 2, "user", "below it", 1.0), (21, 4, None, "assistant", "alone", 0.0)]
    rows += [(22, 1, None, "user", "b", 0.0), (22, 1, None, "user", "a", 0.0), (22, 1, None, "user", "a", 0.0), (22, None, 1, "user", "no id", 0.0)]
    df = spark.createDataFrame([(*r, 1, "x", 0, 0) for r in rows], TREE).repartition(3)
    assert got(chat.format_trees(df, branches)) == plain_paths(rows, branches)


def test_turns(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(HOSTILE)) for c in [*range(6), None] for t in range(rng.randint(1, 9))]
    rows += [(30, 1, "user", "tie b"), (30, 1, "user", "tie a"), (30, 1, "assistant", "same"), (30, 1, "assistant", "same"), (30, None, "user", "last"), (31, 0, "assistant", "x" * 100_000)]
    want = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    df = spark.createDataFrame([(*r, 5, 6, 7) for r in rows], TURNS).repartition(3)
    out = chat.format_turns(df)
    assert got(out) == sorted((repr(digest(c, turns)), 1) for c, turns in want.items())
    # nothing but markers has their form, and spans lie inside
    for r in out.collect():
        assert r.text.count("</turn>") == r.text.count("<turn>") == len(want[r.conv_id])
        assert all(r.text[s.start + s.length :].startswith("</turn>") for s in r.loss)
    assert chat.format_turns(df.limit(0)).count() == 0 and chat.format_trees(spark.createDataFrame([], TREE)).count() == 0


def test_escapes_are_reversible(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["\\", "<", "turn>", "/turn>", "n", "\n", "x"]) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pairs in (chat.ESCAPES, chat.ROLE_ESCAPES):
        e = chat.escaped(F.col("t"), pairs)
        for r in df.select("t", e.alias("e"), chat.unescaped(e, pairs).alias("u")).collect():
            assert r.u == r.t and "<turn>" not in r.e and "</turn>" not in r.e


def test_query_has_the_hostile_conversation_and_no_python(spark):
    df = registry.QUERIES["op12_chat_formatting"](spark, "/root/testdata/sf0.001")
    said = registry.CONTROL_TEXT
    row = df.where("conv_id = -7").first()
    assert (row.conv_id, row.n_turns, row.turns_sha256, row.loss_chars, row.loss_sha256) == digest(-7, [("user", said), ("assistant", said)])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
