from sievework.llm import cutoff


def test_fence_marks_anywhere():
    text = "Title\n\nthe cache failed from version. ```\nx = 1\n```\n\nIt goes on unless a malforme"
    assert [k for k, _ in cutoff.lines_of(text)] == ["prose", "prose", "code", "fence", "prose"]
    assert [k for k, _ in cutoff.lines_of("```\na\n```\nb ```c``` d")] == ["code", "code", "fence", "prose"]
    assert cutoff.open_fence("see ```\nx = 1") and not cutoff.open_fence(text)
    assert cutoff.judge([("see ```\nx = 1", "en", (0, 0))], cutoff.Model([])) == [True]
