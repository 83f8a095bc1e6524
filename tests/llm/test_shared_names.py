import random

import pytest
from pyspark.sql import functions as F

from gleanspark.llm import generated

rng = random.Random(8)
NAMES = [a + b.title() for a in ("load", "scan", "fold", "keep", "move", "draw") for b in ("path", "file", "node", "tree", "part", "rule")]


def code(seed):
    r = random.Random(seed)
    return "\n".join(f"  if ({r.choice(NAMES)} > {r.choice(NAMES)}) return {r.choice(NAMES)}({r.choice(NAMES)}, {r.randint(1, 9)});" for _ in range(60))


PAIRS = [
    ("src/io.c", "lib/io.c"), ("src/db.go", "src/db.go"), ("src/λόγος.py", "a/λόγος.py"), ("src/parser.ts", "src/parser_old.ts"), ("src/range_walker.ts", "src/range_stepper.ts"), ("src/__.py", "src/__.py"),
    ("src/alpha_beta_gamma_delta_echo_fox_yarn_zebra.ts", "src/yarn_zebra.ts"), ("src/.hidden", "x/.hidden"), ("src/7.js", "src/7.js"),
]


@pytest.fixture(scope="module")
def shared(spark):
    rows = [(2 * i + k, f"o/{'ab'[k]}", path, code(i)) for i, pair in enumerate(PAIRS) for k, path in enumerate(pair)]
    rows += [(100, "o/a", "src/unlike.ts", code(99)), (101, "o/b", "src/other.ts", code(99)), (102, "o/a", None, code(98)), (103, "o/b", None, code(98)), (104, "o/a", "src/same.ts", code(97)), (105, "o/a", "lib/same.ts", code(97))]
    df = generated.evidence(spark.createDataFrame(rows, "file_id long, slug string, path string, text string"))
    return {r.file_id: r.shared for r in generated.shared_rules(df).where(F.col("shared") >= 0.5).collect()}


@pytest.mark.parametrize("i", range(len(PAIRS)))
def test_names_that_meet(shared, i):
    assert {2 * i, 2 * i + 1} <= set(shared)


def test_names_that_do_not_meet(shared):
    assert not {100, 101, 102, 103, 104, 105} & set(shared)
