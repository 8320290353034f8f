import pytest

from webmill.functions.regex import java


@pytest.mark.parametrize(
    "pattern, made",
    [
        ("{id}", r"\{id\}"),
        ("a{2}b{1,}c{1,3}", "a{2}b{1,}c{1,3}"),
        ("a{,2}", r"a\{,2\}"),
        ("[$]", "[$]"),
        ("a$", r"a\z"),
        ("[[&&^]", r"[\[\&\&\^]"),
        ("[^]", r"[\s\S]"),
        ("[]", "(?!)"),
        ("(?<n_1>x)\\k<n_1>", "(?<g1>x)\\k<g1>"),
        ("(a)\\1", "(a)(?:\\1)"),
        ("\\7", "\\x07"),
        ("\\z\\-\\/\\d", "z\\-\\/\\d"),
        ("\\u0041\\x42\\xZ", "\\u0041\\x42xZ"),
        ("(?=a)(?!b)(?<=c)(?<!d)(?:e)", "(?=a)(?!b)(?<=c)(?<!d)(?:e)"),
        ("a+?", "a+?"),
        ("", ""),
    ],
)
def test_patterns_are_written_as_java_has_them(pattern, made):
    assert java(pattern) == made


@pytest.mark.parametrize("pattern", ["(?P<a>x)", "(?i)x", "(?>x)", "+x", "a**", "a++", "(", "a)", "[a", "x|*", "\\", "(?<a>x)(?<a>y)", "(?<a>x)\\k<b>"])
def test_what_is_no_pattern_is_none(pattern):
    assert java(pattern) is None
