from hypothesis import given
from hypothesis import strategies as st

from tessera.functions import sequences as q


def test_error_counts_split_a_least_edit():
    assert q.error_counts("abc", "abc") == (0, 0, 0)
    assert q.error_counts("abc", "axc") == (1, 0, 0)
    assert q.error_counts("abc", "ac") == (0, 1, 0)
    assert q.error_counts("ac", "abc") == (0, 0, 1)
    assert q.error_counts("", "xy") == (0, 0, 2)


@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_error_counts_explain_the_lengths(a, b):
    s, d, i = q.error_counts(a, b)
    assert len(a) - d + i == len(b) and s + d + i <= max(len(a), len(b))


def test_agreement_ignores_marks_and_case():
    assert q.agreement("Hello, World!", "hello world") == (1.0, "exact")
    assert q.agreement("", "x")[0] == 0.0 and q.agreement("", "")[0] == 1.0
    ratio, how = q.agreement("ab" * 15000, "ab" * 15000)
    assert how == "windowed" and abs(ratio - 1) < 1e-9
    assert [q.band(x) for x in (0.85, 0.8, 0.7)] == ["agree", "minor", "review"]


def test_cues_end_at_sentences_pauses_and_length():
    cues = q.shape_cues([(0, 500, "Hello"), (500, 1200, "world."), (1300, 1400, "”"), (1500, 2000, "Next"), (4000, 4500, "one")])
    assert [c[2] for c in cues] == ["Hello world.”", "Next one"]
    long_ = q.shape_cues([(k * 100, k * 100 + 90, "abcdefghij") for k in range(10)])
    assert all(len(c[2]) <= 66 for c in long_) and len(long_) > 1


def test_batches_keep_order_and_leave_oversize_alone():
    assert q.pack_batches([5, 5, 5, 100, 1, 1], 10, 2) == [0, 0, 1, 2, 3, 3]


def test_merge_needs_contiguous_numbers():
    assert q.merge_marked([(1, "keep", "a", "b", ""), (2, "use-asr", "a", "b", ""), (3, "custom", "a", "b", "c")]) == [(1, "a"), (2, "b"), (3, "c")]
    try:
        q.merge_marked([(2, "keep", "a", "b", "")])
        raise AssertionError
    except ValueError:
        pass


def test_canonical_json_sorts_keys_and_drops_credentials():
    assert q.canonical_json(q.sanitized({"b": 1, "a": [{"api_token": 2, "é": 3}]})) == '{"a":[{"é":3}],"b":1}'


def test_sensitive_keys_by_name_beginning_end_and_part():
    assert all(map(q.sensitive, ("URL", " Cookie ", "stream_url", "thumburl", "x_trace", "authority", "my_sessdata_1", "a-traceback", "tokens", "secretary")))
    assert not any(map(q.sensitive, ("title", "urls", "my_cookies", "passwords", "trace", "curl_args")))


def test_texts_are_redacted_at_any_depth():
    value = {"a": [{"b": "https://x.example/y"}, "see https://x.example/y", "sign=1 and https://x.example/?auth=2 end"], "c": "Traceback (most recent call last):\n  all", "d": 5, "e": None}
    assert q.sanitized(value) == {"a": [{"b": "[redacted]"}, "see https://x.example/y", "[redacted] and [redacted] end"], "c": "[redacted]", "d": 5, "e": None}


def test_published_blocks_skip_front_matter():
    assert q.published_blocks("---\nx: 1\n---\n00:00:05\nhi\nthere\n```\n00:00:07\n```\n01:00:00\nend") == [(5, "hi there 00:00:07"), (3600, "end")]
