import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanspark.llm import generated, grammar, kernel

rng = random.Random(5)
NAMES = [a + b.title() for a in ("load", "scan", "fold", "keep", "move", "draw", "test", "make") for b in ("path", "file", "node", "tree", "part", "rule", "word", "line")]


def hand(n=40, own="tool"):
    out = [f"// {own} project", 'import { a } from "./b";', ""]
    for _ in range(n):
        f, g, h = rng.choices(NAMES, k=3)
        out.append(rng.choice([f"  const {f} = {g}({h}, {rng.randint(1, 9)});", f"function {f}({g}) {{", f"  if ({f} > {g}.{h}) return {h};", "}", "", f"  for (const {f} of {g}({h})) {{", f"  // {f} goes before {g} when the {h} is late", f"  {f}.{g} += {h};"]))
    return "\n".join(out)


def test_grammar_sizes():
    def size(seq):
        h = kernel.mix(np.array(seq, np.uint64))
        n, g, c = grammar.repair(h, np.zeros(len(h), np.int64), 1)
        return n[0], g[0], c[0]

    assert size(list(range(100))) == (100, 100, 0)
    n, g, c = size(list(range(8)) * 64)
    assert n == 512 and g < 60 and c == 512
    assert size([7] * 256)[1] < 30
    assert size([]) == (0, 0, 0) and size([1]) == (1, 1, 0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=40), min_size=1, max_size=6))
def test_sequences_of_a_block_are_independent(seqs):
    doc = np.repeat(np.arange(len(seqs)), [len(s) for s in seqs])
    h = kernel.mix(np.array([x for s in seqs for x in s], np.uint64))
    together = grammar.repair(h, doc, len(seqs))[1].tolist()
    alone = [grammar.repair(kernel.mix(np.array(s, np.uint64)), np.zeros(len(s), np.int64), 1)[1][0] for s in seqs]
    assert together == alone
    assert all(g <= len(s) for g, s in zip(together, seqs))


def test_phrases_cover_and_repeat():
    a, b = rng.choices(range(50), k=300), rng.choices(range(50, 90), k=30)
    both = np.array([*a, *b, *a], np.uint64)
    h, _, w = grammar.phrases(kernel.mix(both), np.zeros(len(both), np.int64))
    assert w.sum() == len(both)
    one, _, w1 = grammar.phrases(kernel.mix(np.array(a, np.uint64)), np.zeros(300, np.int64))
    assert sum(int(x) for x, y in zip(w1, one) if y in set(h.tolist())) > 200


def files():
    shared = hand(60, "lib")
    return {
        1: ("o/tool", "src/a.ts", hand(), None), 2: ("o/tool", "src/b.ts", "// Code generated by gen. DO NOT EDIT.\n" + hand(10), "generated"),
        3: ("o/tool", "src/c.ts", "\n".join(f"  case {rng.randint(1, 9999)}: return {rng.choice(NAMES)}({i});" for i in range(80)), "generated"),
        4: ("o/tool", "src/d.js", ";".join(f"{rng.choice('abc')}={rng.choice('def')}({rng.choice('xyz')},{i})" for i in range(300)), "minified"),
        5: ("o/tool", "src/e.py", "x = '''" + "\n".join("".join(rng.choices("abcXYZ019+/", k=76)) for _ in range(20)).replace("+", "q").replace("/", "r") + "'''", "data"),
        6: ("o/tool", "src/f.ts", "t = [" + ", ".join(str(rng.randint(0, 999)) for _ in range(400)) + "]", "data"),
        7: ("o/tool", "node_modules/x/g.js", hand(), "vendored"), 8: ("o/tool", "third_party\\y\\h.c", None, "vendored"), 9: ("o/tool", "src/i.ts", "// This file belongs to otherlib.\n" + hand(), "vendored"),
        10: ("o/tool", "src/j.ts", "// Snapshot of foolib at tag 1.2.3. Local patches: none.\n" + hand(), "vendored"), 11: ("o/tool", "lib/range_walker.ts", shared, "vendored"), 12: ("p/else", "src/range_walker_old.ts", shared.replace("lib project", "else project"), "vendored"),
        13: ("o/tool", "src/generator.ts", hand(20) + '\n  out.write("Code generated by " + x + ". DO NOT EDIT.");\n', None), 14: ("o/tool", "src/deps_check.ts", hand(), None), 15: ("o/tool", "README.md", "generated by hand " * 90, None),
        16: ("o/tool", None, "", None), 17: (None, "src/k.ts", hand(30).replace("tool project", ""), None), 18: ("o/tool", "src/l.ts", "// the ids are generated at start by f, edit them here by hand\n" + hand(), None),
    }


def test_kinds(spark):
    want = files()
    rows = [(i, s, p, t, 1, "x") for i, (s, p, t, _) in want.items()]
    rows[10] = (11, "o/lib", *rows[10][2:])
    df = spark.createDataFrame([*rows, rows[0], (None, "o/tool", "vendor/x.c", "lost", 1, "x")], "file_id long, slug string, path string, text string, n long, kind string")
    got = {r.file_id: r.kind for r in generated.kinds(df).collect()}
    assert got == {i: k for i, (_, _, _, k) in want.items()}
    assert {r.file_id for r in generated.not_handwritten(df).collect()} == {i for i, (_, _, _, k) in want.items() if k}
    assert generated.kinds(df.limit(0)).count() == 0
