from sievework.llm.languages import language_of


def test_unknown_names_leave_it_to_the_extension():
    assert language_of("Python 2.7 or so", "a/b.py") == "python" and language_of("ruby", "a/b.rb") is None
    assert language_of("c", "a/b.py") == "c" and language_of(None, "x.hpp") == "c++"
