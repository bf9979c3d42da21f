import corpus_pipeline


def test_stages_return_documents_columns(spark, edge_docs):
    docs = edge_docs
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == corpus_pipeline.COLUMNS, name
    assert "bin" in corpus_pipeline.STAGES[-1][1](spark, docs, sf).columns


def test_run(spark):
    sf = "/root/testdata/sf0.001"
    packed = corpus_pipeline.run(spark, sf)
    ids = {r.doc_id for r in packed.select("doc_id").distinct().collect()}
    assert ids and ids <= {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}


def test_run_on_no_documents(spark, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.count() == 0


def test_stages_against_plain_versions(spark, sf_dir):
    """Each stage on its own input: what it keeps and changes, by the definition."""
    import collections

    from factloom.llm import best_fit, nbsvm, source_mix
    from test_operators import near_groups, pairs

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(corpus_pipeline.COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: collections.Counter(tuple(r) for r in df.select(corpus_pipeline.COLUMNS).collect())

    good = {r.doc_id for r in nbsvm.classify(docs, labels).filter("predicted = 1").collect()}
    kept = stages["quality"](spark, docs, sf_dir)
    assert rows(kept) == rows(docs.filter(docs.doc_id.isin(list(good))))

    groups = near_groups(pairs(docs), 5, 80)
    firsts = [i for i, (_, c) in groups.items() if i == c]
    assert rows(stages["near_duplicates"](spark, docs, sf_dir)) == rows(docs.filter(docs.doc_id.isin(firsts)))

    seen, want = set(), {}
    for i, text in sorted(pairs(docs)):
        raw = text.encode()
        gone = bytearray(len(raw) + 1)
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = b"\x01" * 100
            seen.add(raw[p : p + 100])
        out, at = [], 0
        for c in text:  # a character goes if all its bytes do
            n = len(c.encode())
            if not all(gone[at : at + n]):
                out.append(c)
            at += n
        want[i] = "".join(out)
    cut = {r.doc_id: (r.text, r.n_chars) for r in stages["repeated_passages"](spark, docs, sf_dir).collect()}
    assert cut == {i: (t, len(t)) for i, t in want.items()} and any(len(t) < len(x) for (i, x), t in zip(sorted(pairs(docs)), (want[i] for i, _ in sorted(pairs(docs))), strict=True))

    copies = source_mix.mix_sources(docs)
    assert rows(stages["mixed"](spark, docs, sf_dir)) == rows(copies)
    places = stages["packed"](spark, docs, sf_dir).collect()
    bins = collections.Counter()
    for r in places:
        bins[r.bin, r.capacity] += r.n_tokens
    assert all(used <= cap for (_, cap), used in bins.items()) and sum(bins.values()) == sum(len(t.encode()) + 1 for _, t in pairs(docs))
    assert max(c for _, c in bins) <= max(best_fit.CAPACITIES)
