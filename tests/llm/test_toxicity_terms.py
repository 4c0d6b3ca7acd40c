"""All terms of the labelled sample count, with document frequencies of all documents."""

import numpy as np

from serialspark.llm import toxicity


def test_all_terms_count(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    index = toxicity.fit(d, labels)
    texts = [r.text for r in d.select("text").collect()]
    have = [set(toxicity.term_counts(t)) for t in texts]
    learned = {int(i) for i in index.doc_ids}
    assert set(index.terms) == set().union(*[toxicity.term_counts(r.text) for r in d.where(d.doc_id.isin(learned)).collect()])
    some = index.terms[:: len(index.terms) // 50]
    counted, n = toxicity.document_counts(d, some)
    assert n == len(texts) and counted.tolist() == [sum(t in h for h in have) for t in some]
    known = set(index.terms)
    for r in toxicity.score_documents(d, labels).select("doc_id", "evidence").join(d, "doc_id").collect():
        assert bool(r.evidence) == bool(known & set(toxicity.term_counts(r.text)))
    assert np.all(index.idf > 0)
