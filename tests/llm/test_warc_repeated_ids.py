"""Archives of pages whose ids repeat with other payloads."""

import hashlib

from corpora import write

from tessera.llm import op01_warc_writer as op1


def test_a_revisit_is_decided_by_id_and_payload(spark, tmp_path):
    a, b, c = ("<p>" + x * 200 for x in "abc")
    pages = [(1, "http://x/a", a), (2, "http://x/b", b), (5, "http://x/5", a), (5, "http://x/5", b), (5, "http://x/5", c), (5, "http://x/5", c)]
    got = op1.query(spark, write(tmp_path, pages=pages)).select("page_id", "payload_digest", "record_type", "refers_to").collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(1, sha(a), "response", None), (2, sha(b), "response", None), (5, sha(a), "revisit", 1), (5, sha(b), "revisit", 2)] + 2 * [(5, sha(c), "response", None)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
