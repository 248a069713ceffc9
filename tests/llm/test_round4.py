"""Findings of round 3 on the corpus operators."""

from pagesift.llm import simhash

from .cases import docs, prose


def test_near_dedup_takes_simhash_pairs(spark, monkeypatch):
    """Near copies whose fingerprints differ little come by SimHash; those that differ more by the join of shingles."""
    words = prose(3000, 1).split()
    light, heavy = words[:-1] + ["end"], list(words)
    for i in range(50):  # each changes five of 2,996 shingles: a similarity of 0.85
        heavy[60 * i + 10] = "edit"
    frame = docs(spark, [" ".join(words), " ".join(light), " ".join(heavy), prose(3000, 2)])
    found, made = [], simhash.fingerprint_pairs

    def kept(prints):
        pairs = made(prints)
        found.extend(pairs.collect())
        return pairs

    monkeypatch.setattr(simhash, "fingerprint_pairs", kept)
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame).collect()}
    assert len(found) == 1 and groups == {0: 0, 1: 0, 2: 0, 3: 3}
