import re

from pyspark.sql import functions as F

from ranklane.llm import quality as q


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit))


def test_measures_as_written_out():
    for t in ["", None, " \n", "a", "a b c a b c", "a a a a a", "x y z\nx y z\n\n \xa0\n\xa0", "é#*\x0b$ %&|<> ü",
              "p q r s p q r t p q r", "one two three", "l\nl\nl \n l", "a\x1cb c\x85d"]:
        assert q.measure(t)[:5] == plain(t), t


def test_policies_and_ablations_read_bits_alone(spark):
    bits = [0, 1, 1, 2, 3, 4, 64, 65, 0, 8]
    entries = spark.createDataFrame([(b,) for b in bits], "failed long")
    for p in q.POLICIES:
        assert entries.where(q.passes(p)).count() == sum(not b & p.mask for b in bits)
    for r in q.ablations(entries).collect():
        mask, bit = q.policy(r.policy, r.version).mask, q.BIT[r.rule]
        assert r.n_failed == sum(bool(b & bit) for b in bits)
        assert r.n_alone == sum(b & mask == bit for b in bits)
        assert r.n_kept == sum(not b & mask for b in bits)
        assert r.n_kept_without == sum(not b & mask & ~bit for b in bits)


def test_odd_rows(odd, empty):
    rows = q.ledger(odd)
    assert rows.count() == odd.count() and q.ledger(empty).count() == 0 and q.ablations(q.ledger(empty)).count() == 0
    got = {r.doc_id: r for r in rows.collect()}
    assert got[1].failed == got[2].failed == got[3].failed == q.BIT["few_words"]
    assert got[4].n_words == 30_000 and got[4].failed & q.BIT["repeated_words"]
    assert rows.where(F.col("doc_id").isNull()).count() == 1
