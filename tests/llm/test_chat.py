"""Chat windows: exact round trips, budgets and masks."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pixelstrata.llm import chat_windows as C

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<\\s>", "[\\/INST]", "<", "\n", "é漢🙂", "</s>\n", "\n[INST]", "a b"]


def rows_of(seed, conversations=12, turns=40):
    rng, rows = random.Random(seed), []
    for c in range(conversations):
        for k in range(rng.randrange(1, turns)):
            role = "system" if k == 0 and c % 2 else rng.choice(["user", "assistant", "tool", None, "x\n[INST]"])
            rows.append((c, k, role, rng.choice([None, ""] + ["".join(rng.choice(CONTROLS) for _ in range(rng.randrange(60))) for _ in range(4)])))
    return rows


def expected(rows):
    by = defaultdict(list)
    for c, k, role, text in rows:
        by[c].append((k is not None, k or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        spoken = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[c] = (len(turns), hashlib.sha256(spoken.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("budget", [64, 400, 1024])
def test_read_back_is_exact(spark, budget):
    rows = rows_of(budget)
    made = C.windows(table(spark, rows), budget=budget)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.read_back(made).collect()}
    assert got == expected(rows)


def test_budget_history_and_system(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, k, "user" if k % 2 else "assistant", " ".join(["w"] * 30)) for k in range(1, 60)]
    made = C.windows(table(spark, rows), budget=300, history=90, system=40).orderBy("first").collect()
    assert len(made) > 5 and all(r.tokens <= 300 for r in made)
    assert all(r.formatted.startswith("<s>system\n[INST]be kind[/INST]</s>\n") for r in made)
    assert made[0].repeated == 0 and all(r.repeated == 3 for r in made[1:])  # the system turn and two of history
    assert sum(len(r.loss) for r in made) == sum(r[2] == "assistant" for r in rows)
    for r in made:
        assert all(r.formatted[s.start : s.end] == " ".join(["w"] * 30) for s in r.loss)


def test_long_turn_is_whole(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "w " * 50_000), (1, 2, "user", "r")]
    made = C.windows(table(spark, rows), budget=200).orderBy("first").collect()
    assert max(r.tokens for r in made) > 50_000
    got = {r.conv_id: tuple(r)[1:5] for r in C.read_back(C.windows(table(spark, rows), budget=200)).collect()}
    assert {k: v for k, v in got.items()} == expected(rows)


def test_long_conversation_null_ids_repeats_and_extra_columns(spark):
    rows = [(7, k, "assistant", f"t{k}") for k in range(3000)] + [(None, 0, "user", "a"), (None, None, "assistant", "b")]
    rows += [(8, 1, "assistant", "same"), (8, 1, "assistant", "same")]
    df = table(spark, rows).withColumn("first", F.lit("clash")).withColumn("tokens", F.lit(None).cast("int"))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.read_back(C.windows(df)).collect()}
    assert got == expected(rows)
    assert C.read_back(C.windows(df.limit(0))).count() == 0


def test_no_python_in_the_plan(spark, sf):
    from pixelstrata.llm.queries import QUERIES

    plan = QUERIES["op4_chat_formatting"](spark, sf)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "ExistingRDD[obj"))


def test_query_on_whole_table(spark, sf):
    from pixelstrata.llm.queries import QUERIES

    hard = "</s>[INST] ok [/INST]"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()] + [(-1, 0, "user", hard), (-1, 1, "assistant", hard)]
    out = QUERIES["op4_chat_formatting"](spark, sf).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out} == expected(rows)
    assert all(r.formatted_chars > r.loss_chars for r in out)
