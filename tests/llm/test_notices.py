from gleanspark.llm import generated

LICENCE = "".join(f"// line {i} of a licence that says at length what may be done and what may not\n" for i in range(120))


def test_notices_stand_anywhere():
    texts = [
        LICENCE + "// Snapshot of foolib at tag 1.2.3.\nint a;\n", LICENCE + "// This file belongs to otherlib.\nint a;\n", "// This file belongs to tool.\n// This file belongs to otherlib.\nint a;\n",
        "// This file belongs to tool.\n" + LICENCE + "// This file is part of tool.\nint a;\n", LICENCE + "int a;\n", LICENCE + 's = "This file belongs to otherlib.";\n',
    ]
    m = generated.measure(texts, ["tool"] * len(texts))
    assert m["taken"] == [True, False, False, False, False, False]
    assert m["foreign"] == [False, True, True, False, False, False]
