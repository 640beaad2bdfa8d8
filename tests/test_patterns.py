"""Search patterns in the users' dialect against Java's engine."""

import pytest

from copperline.functions.patterns import InvalidPattern, java_pattern
from copperline.operators.components import checked_pattern

#: Pattern, texts in which it is found, texts in which it is not.
FOUND = [
    (r"[*+]", ["a*", "+3V3"], ["ab"]),
    (r"C\++", ["C+", "C++"], ["CC"]),
    (r"\++3V3", ["+3V3", "++3V3"], ["3V3"]),
    (r"A$|B$", ["xA", "B"], ["A\n", "Ax"]),
    (r"^A\$B$", ["A$B"], ["A$B\n", "AB"]),
    (r"\\$", ["a\\"], ["a\\b"]),
    (r"[$]x", ["$x"], ["x"]),
    (r"[[a]", ["[", "a"], ["b"]),
    (r"[a&&b]", ["&", "a", "b"], ["c"]),
    (r"[^\]x]", ["a"], ["]", "x"]),
    (r"a{,2}", ["a{,2}"], ["aa"]),
    (r"a{2,}?b{1}", ["aab"], ["ab"]),
    (r"x]}", ["x]}"], ["x"]),
    (r"\Ab\z", ["Abz"], ["b"]),
    (r"\Q.\E", ["QxE"], ["."]),
    (r"[]|q", ["q"], ["x", "]"]),
    (r"a[^]b", ["a\nb"], ["ab"]),
    (r"a.b", ["a\u0085b"], ["a\nb", "a b"]),
    (r"a\sb", ["a b", "a b"], ["ab"]),
    (r"a[\s,]b", ["a b", "a,b"], ["ab"]),
    (r"^[\S]+$", ["ab"], ["a b"]),
    (r"\x41B\v\0", ["AB\x0b\x00"], ["AB"]),
    (r"(?<n>a|b)\k<n>", ["aa"], ["ab"]),
    (r"(?<a_b>x|y)(?<aZ>z)\k<a_b>\k<aZ>", ["xzxz"], ["xzyz"]),
    (r"(?<$1>a)(?<_>b)\k<_>\k<$1>", ["abba"], ["abab"]),
    (r"(a|b)+?c(?!d)(?=e)", ["abce"], ["abcd"]),
    (r"(?<=a)b(?<!ab)|zz", ["zz"], ["ab"]),
    (r"[\b]|\bend\b", ["\x08", "the end"], ["bender"]),
    (r"[\w-]+", ["a-b"], ["+"]),
    (r"\cJ", ["\n"], ["J"]),
    (r"[a^]", ["^", "a"], ["b"]),
]


@pytest.mark.parametrize(("pattern", "met", "missed"), FOUND)
def test_patterns_find_what_they_say(spark, pattern, met, missed):
    java = spark.sparkContext._jvm.java.util.regex.Pattern.compile(checked_pattern(spark, pattern))
    assert [t for t in met if not java.matcher(t).find()] == [] and [t for t in missed if java.matcher(t).find()] == []


@pytest.mark.parametrize("pattern", ["a++", "a*+", "a?+", "a{2}+", "*a", "a|*", "(?i)a", "(?s:a)", "(", "a)", "[a", "\\", "^*", "(?<1>a)", "a{3,2}"])
def test_what_the_dialect_does_not_have_is_refused(spark, pattern):
    with pytest.raises(InvalidPattern):
        checked_pattern(spark, pattern)


def test_plain_patterns_stay():
    assert java_pattern("^N1[0-9]*7") == "^N1[0-9]*7" and java_pattern("") == ""
