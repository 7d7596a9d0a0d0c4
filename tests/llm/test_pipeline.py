"""The pipeline's stages against brute force."""

import collections

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_operators import brute_groups, brute_lines, plain, sha


def test_stages(spark, edge_docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = edge_docs.select("doc_id", "text", "lang", "source", "n_chars")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing", "BPE round trip"]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    step = {name: (lambda d, f=f: f(spark, d, str(tmp_path))) for name, f in corpus_pipeline.STAGES}
    kept = step["toxicity"](docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()  # nothing to learn from here
    lines = step["line dedup"](docs)
    assert collections.Counter((d, sha(t or "")) for d, t in plain(lines)) == collections.Counter((d, s) for d, _, _, s in brute_lines(plain(docs)))
    alone = step["n-gram Jaccard join"](lines)
    groups = collections.defaultdict(set)
    for (d, t), (_, n, c, _) in zip(plain(lines), brute_groups(plain(lines)), strict=True):
        groups[(c, t if d == 8 else None) if n else (d, t, len(groups))].add((d, t))  # two groups have 8 as their smallest id
    assert len(plain(alone)) == len(groups) and all(sum(row in rows for row in plain(alone)) >= 1 for rows in groups.values())
    mixed = step["mixing"](alone)
    assert mixed.columns == docs.columns and {d for d, _ in plain(mixed)} <= {d for d, _ in plain(alone)}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in step["BPE round trip"](mixed).collect():
        assert r["decoded_sha256"] in {sha(t or "") for _, t in plain(mixed)}
    tokens = sum(len(library.encode(t or "", add_special_tokens=False).ids) for _, t in plain(mixed))
    assert sum(r["n_tokens"] for r in step["BPE round trip"](mixed).collect()) == tokens
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
