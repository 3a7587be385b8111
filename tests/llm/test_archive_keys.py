"""Keys near both ends of a long take part in the revisit decision."""

from __future__ import annotations

from tidewell.llm import archives


def test_keys_of_nineteen_digits(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    keys = [high, high - 1, low + 1, low, 10**18, -(10**18), 999_999_999_999_999_999, 0]
    df = spark.createDataFrame([(k, f"http://a/{k}", "x" * 200) for k in keys] + [(high - 2, "http://b", "y" * 200), (high - 3, "http://b", "y" * 200)], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in archives.round_trip(df).collect()}
    assert got == {k: ("revisit", low) for k in keys} | {low: ("response", None), high - 2: ("revisit", high - 3), high - 3: ("response", None)}


def test_what_is_no_key():
    assert [archives.key_of(x) for x in (None, "", "x", "9223372036854775807", "-9223372036854775808", "9223372036854775808", "-9223372036854775809", "1 2", "٣")] == [None, None, None, (1 << 63) - 1, -(1 << 63), None, None, None, None]
