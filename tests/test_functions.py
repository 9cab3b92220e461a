import re

import pytest

from sievemark.functions import formats, uri
from sievemark.functions.regex import RegexSyntaxError, is_unsafe, matcher, to_java
from sievemark.plans.errors import JsonSyntaxError
from sievemark.sources.positions import parse_with_ranges

# The reference resolution examples of RFC 3986, section 5.4.
RESOLVED = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", ";x": "http://a/b/c/;x", "": "http://a/b/c/d;p?q",
    ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h",
}


@pytest.mark.parametrize("reference, wanted", RESOLVED.items())
def test_resolution(reference, wanted):
    assert uri.resolve("http://a/b/c/d;p?q", reference) == wanted


def test_other_schemes():
    assert uri.resolve("urn:example:a", "#x") == "urn:example:a#x"
    assert uri.defragged("a#") == ("a", "") and uri.defragged("a") == ("a", None)
    assert uri.encoded("/a b/%/é") == "/a%20b/%25/%C3%A9"


FORMATS = {
    "date": (["2020-02-29", "0000-02-29"], ["1900-02-29", "2020-2-9", "2020-01-01\n", "٢٠٢٠-01-01"]),
    "time": (["23:59:60Z", "08:30:06.28+01:00", "00:59:60+01:00"], ["22:59:60Z", "24:00:00Z", "08:30:06", "08:30:06+24:00"]),
    "date-time": (["1998-12-31T15:59:60.123-08:00", "1963-06-19t08:30:06z"], ["1998-12-31 15:59:60Z", "1998-12-31T23:59:61Z", "2020-02-30T00:00:00Z"]),
    "duration": (["P4Y", "P1M2D", "PT36H", "P1DT12H", "P4W", "PT0S"], ["P", "PT", "P1Y2W", "4Y", "P1Y1D", "P1.5D", "P1S"]),
    "email": (["a@b", "a.b+c@x-y.org", '"a b"@c.d', "x@[127.0.0.1]", "x@[IPv6:::1]"], ["a", "a..b@c", ".a@b", "a@[1.2.3]", "a@-b", "é@b"]),
    "idn-email": (["실례@실례.테스트", "a@b"], ["@b"]),
    "hostname": (["a.b-c.d", "xn--nxasmq6b", "1"], ["-a", "a-", "a..b", "a_b", "x" * 64, "", "a."]),
    "idn-hostname": (["실례.테스트", "a"], ["〮실례", "-a", ""]),
    "ipv4": (["1.2.3.4", "255.0.0.255"], ["1.2.3", "01.2.3.4", "256.1.1.1", "1.2.3.4 "]),
    "ipv6": (["::", "::1", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "1::8"], ["1::2::3", ":1", "12345::", "::1%eth0", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9"]),
    "uri": (["http://a/b?c#d", "urn:x:y", "mailto:a@b", "http://[::1]:80/", "a:"], ["//a", "a b", "http://a/[", "http:// x", "%gg:"]),
    "uri-reference": (["", "//a", "#x", "a/b", "/"], ["\\a", "a b", "#a#b"]),
    "iri": (["http://é/ü"], ["é"]),
    "iri-reference": (["é", "//ü"], ["\\"]),
    "uri-template": (["a{b}", "{+a,b*}/{?c:3}", "it's"], ["{", "a}", "{a:0}", "{a b}"]),
    "uuid": (["2EB8AA08-aa98-11ea-b4aa-73b441d16380"], ["2eb8aa08aa9811eab4aa73b441d16380", "x"]),
    "json-pointer": (["", "/", "/a~0b~1", "/a//b"], ["a", "/~", "/~2"]),
    "relative-json-pointer": (["0", "1/a", "0#"], ["/a", "01", "-1", "0##", ""]),
    "regex": (["^a+$", "(?<a>x)\\k<a>"], ["(", "\\a", "a{2,1}"]),
}


@pytest.mark.parametrize("name", FORMATS)
def test_formats(name):
    test = formats.test_for(name)
    for s in FORMATS[name][0]:
        assert test(s), s
    for s in FORMATS[name][1]:
        assert not test(s), s


def test_pattern_formats_agree_with_java(spark):
    from pyspark.sql import functions as F

    for name, pattern in formats.PATTERNS.items():
        for wanted, texts in zip((True, False), FORMATS[name]):
            rows = spark.createDataFrame([(t,) for t in texts], "s string")
            assert {r[0] for r in rows.select(F.col("s").rlike(rf"\A(?s:{pattern})\z")).collect()} <= {wanted}, name


REGEXES = [("^a.c$", ["abc", "a\u0085c"], ["abc\n", "a\nc", "a c"]), ("\\s+", ["﻿", " "], ["\u0085", "x"]), ("\\bé", ["aé", "xé"], ["é"]), ("[^\\d\\w]", ["é", "-"], ["a", "1"]), ("\\p{L}\\P{Lu}", ["aé"], ["AB"]), ("(a)|\\1b", ["a", "b"], ["c"]), ("[\\s\\S]", ["\n"], [""]), ("[]", [], ["", "a"]), ("(?<=a)b", ["ab"], ["b"]), ("\\u{1F600}", ["\U0001f600"], ["x"]), ("a{2}", ["aa"], ["a"])]


@pytest.mark.parametrize("pattern, good, bad", REGEXES, ids=[r[0] for r in REGEXES])
def test_regexes(spark, pattern, good, bad):
    from pyspark.sql import functions as F

    m = matcher(pattern)
    rows = spark.createDataFrame([(s, True) for s in good] + [(s, False) for s in bad], "s string, w boolean")
    for r in rows.select("s", "w", F.col("s").rlike(to_java(pattern)).alias("j")).collect():
        assert bool(m.search(r.s)) is r.w and r.j is r.w, r


@pytest.mark.parametrize("pattern", ["(", "a**", "[b-a]", "\\a", "\\p{Nope}", "a{1", "(?<a>x)(?<a>y)", "\\2(a)", "{", "]"])
def test_bad_regexes(pattern):
    with pytest.raises(RegexSyntaxError):
        matcher(pattern)


def test_unsafe():
    assert is_unsafe("(a+)+") and not is_unsafe("(a{1,9})+") and re.compile("x")


def test_positions():
    value, found = parse_with_ranges('{\n  "a/b": [1, "x"]\n}')
    assert value == {"a/b": [1, "x"]}
    assert found.place(found.keys["/a~1b"][0]) == (2, 3, 4) and found.values["/a~1b/1"] == (15, 18)
    for text in ('{"a":1,}', "[1 2]", '"\x01"', "[1] 2", "", "01", '"\\x"'):
        with pytest.raises(JsonSyntaxError):
            parse_with_ranges(text)
