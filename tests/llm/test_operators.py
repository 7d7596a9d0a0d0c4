"""Each operator against brute force on edge cases and on the smallest tables."""

import collections
import hashlib
import html
import pickle
import random
import re
import time
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqloom.llm import ann, bpe, html_extract, line_dedup, mixing, ngram_join, quality_rules, substring_dedup, token_files, toxicity
from seqloom.llm.registry import oracle_sql, queries
from seqloom.shipping import ship

SMALLEST = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"
WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def bag(rows):
    return collections.Counter(tuple(r) for r in rows)


def brute_groups(docs):
    """n_shingles, component and links of each document, by comparing all pairs."""
    sets = []
    for _, t in docs:
        w = WORDS((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = collections.defaultdict(set)
    for a in range(len(docs)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                links[a].add(b)
                links[b].add(a)
    out = []
    for a in range(len(docs)):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        ids = [docs[b][0] for b in seen if docs[b][0] is not None]
        out.append((docs[a][0], len(sets[a]), min(ids) if ids else None, len(links[a])))
    return out


def test_ngram_join(spark, edge_docs, monkeypatch):
    found = ngram_join.jaccard_groups(edge_docs).collect()
    assert bag(found) == bag(brute_groups(plain(edge_docs)))
    kept = ngram_join.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns and {2, 3}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_one_row_of_each_group_stays(spark):
    """Rows are told apart by id and text, and extra columns may have any name."""
    ship(spark)
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    docs = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, d), (None, d), (None, d + " more"), (4, ""), (4, ""), (5, None), (6, a.upper()), (1, a)]
    df = spark.createDataFrame([(i, t, n, n, n) for n, (i, t) in enumerate(docs)], "doc_id long, text string, _gone int, row int, verdict int")
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    found = collections.Counter(plain(kept))
    near = {(None, d): found.pop((None, d), 0), (None, d + " more"): found.pop((None, d + " more"), 0)}
    assert sum(near.values()) == 1
    assert found == collections.Counter([(1, a), (2, b), (3, c), (4, ""), (4, ""), (5, None)])


def test_ngram_join_of_a_large_group_in_blocks(spark, monkeypatch):
    """Near copies that reach one another only through chains, with tiny blocks and lists."""
    ship(spark)
    rnd = random.Random(1)
    words = [f"v{i}" for i in range(120)]
    docs = []
    for i in range(90):
        text = list(words)
        for _ in range(rnd.randrange(5)):
            text[rnd.randrange(120)] = f"edit{rnd.random()}"
        docs.append((i, " ".join(text)))
    docs += [(100 + i, " ".join(f"u{rnd.randrange(10**9)}" for _ in range(50))) for i in range(10)]
    monkeypatch.setattr(ngram_join, "FEW", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    found = ngram_join.jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert bag(found) == bag(brute_groups(docs))


def test_packed_fingerprints():
    values = np.array([1 << 63, 5, 70000, 3], np.uint64)
    assert ngram_join.widen(ngram_join.narrow(values)).tolist() == values.tolist()
    assert ngram_join.widen(ngram_join.narrow(values[:1])).tolist() == values[:1].tolist()


def brute_substrings(docs):
    first = {}
    for d, t in docs:
        w = WORDS(t or "")
        for i in range(len(w) - 12) if d is not None else []:
            key = tuple(w[i : i + 13])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, t in docs:
        w = WORDS(t or "")
        gone = {p for i in range(len(w) - 12) if d is not None and first[tuple(w[i : i + 13])] < d for p in range(i, i + 13)}
        out.append((d, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))))
    return out


def test_substring_dedup(spark, edge_docs):
    found = substring_dedup.marked(edge_docs, digest=True).drop("n_spans").collect()
    assert bag(found) == bag(brute_substrings(plain(edge_docs)))
    spans = {(r["doc_id"], r["start"], r["n_words"], r["source"]) for r in substring_dedup.repeated_spans(edge_docs).collect()}
    assert (10, 0, 60, 9) in spans and (2, 0, 300, 1) in spans


@pytest.mark.parametrize("bits", [64, 6])
def test_paths_of_documents_with_common_passages(spark, bits):
    """Passages at any place, copies with edits, loops; with 6 bits nearly all edges collide, and words must tell them apart."""
    ship(spark)
    rnd = random.Random(bits)
    base = [[f"p{k}w{rnd.randrange(6 if k == 3 else 10**6)}" for _ in range(40)] for k in range(4)]
    docs = [(None, " ".join(base[0])), (60, None), (61, "short text")]
    for i in range(60):
        text = [f"own{i}x{j}" for j in range(rnd.randrange(20))]
        for _ in range(rnd.randrange(4)):
            part = list(rnd.choice(base))[rnd.randrange(20) :]
            if rnd.random() < 0.3:
                part[rnd.randrange(len(part))] = "edit"
            text += part
        docs.append((i // 2 if i > 50 else i, "  ".join(text)))
    found = substring_dedup.marked(spark.createDataFrame(docs, "doc_id long, text string"), False, bits).collect()
    assert bag((r["doc_id"], r["n_words"], r["n_removed"], sha(r["kept"])) for r in found) == bag(brute_substrings(docs))
    texts = collections.defaultdict(list)
    for d, t in docs:
        texts[d].append(WORDS(t or ""))
    own = {(r["doc_id"], r["n_words"], r["n_removed"]): r["spans"] for r in found}
    assert sum(len(s) for s in own.values()) > 20
    for (d, n, _), spans in own.items():
        for s in spans:
            here = [w[s["start"] : s["start"] + s["n_words"]] for w in texts[d] if len(w) == n]
            there = [w[s["source_start"] : s["source_start"] + s["n_words"]] for w in texts[s["source"]]]
            assert s["source"] < d and s["n_words"] >= 13 and any(h == t for h in here for t in there)


def brute_lines(docs):
    held = collections.defaultdict(set)
    for d, t in docs:
        for key in {x.strip(SPACES).translate(LOWER) for x in (t or "").split("\n")}:
            if len(key) >= 20:
                held[key].add(-1 if d is None else d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(h := held[x.strip(SPACES).translate(LOWER)]) < 3 or max(h) == (-1 if d is None else d)]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def test_line_dedup(spark, edge_docs):
    bitmaps = line_dedup.keep_bitmaps(edge_docs)
    found = line_dedup.apply_bitmaps(edge_docs, bitmaps, digest=True).collect()
    assert bag(found) == bag(brute_lines(plain(edge_docs)))
    kept = line_dedup.dedup_lines(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count()
    assert bag((r["doc_id"], sha(r["text"] or "")) for r in kept.collect()) == bag((d, s) for d, _, _, s in found)


def test_line_groups_across_partitions(spark):
    """One line in all documents, over many partitions of sorted rows."""
    ship(spark)
    docs = [(i, f"a line that is in all of them\nonly {i} here, and nowhere else") for i in range(400)]
    # lines of many rows but few documents, which also lie over partitions
    docs += [(500 + i % 2, f"a line of only two documents\nrow {i}") for i in range(400)] + [(600 + i % 3, f"a line of three documents, no more\nrow {i}") for i in range(300)]
    docs += [(700, "a line that has rows of one document")] * 5 + [(None, f"a line of three documents, no more\nrow {i} of none") for i in range(2)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        found = line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df), digest=True).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert bag(found) == bag(brute_lines(docs))


def test_bpe_matches_the_library(spark, edge_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe.codec(path)
    rnd = random.Random(2)
    texts = [t or "" for _, t in plain(edge_docs)] + ["x" * 3000, "\x1c\x85  z​", "👍🏽 don't we'LL 1234５６"]
    texts += ["".join(rnd.choice("ab é\n'ſ\tz1., ́日") for _ in range(200)) for _ in range(200)] + ["".join(rnd.choice("abetinorsh") for _ in range(500)) for _ in range(10)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    found = bpe.round_trip(edge_docs, path).collect()
    expected = [(d, len(i), sha(",".join(map(str, i))), sha(t or "")) for d, t in plain(edge_docs) for i in [library.encode(t or "", add_special_tokens=False).ids]]
    assert bag(found) == bag(expected)
    back = bpe.decode_documents(bpe.encode_documents(edge_docs, path), path)
    assert bag(plain(back)) == bag((d, t or "") for d, t in plain(edge_docs))


def test_token_files(spark, edge_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    files = token_files.write_files(edge_docs, path, length=64)
    found = sorted(tuple(r) for r in token_files.read_documents(files).select("start", "doc_id", "n_tokens", "ids_crc32").collect())
    docs = sorted(plain(edge_docs), key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    start, expected = 0, []
    for d, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        expected.append((start, d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert found == expected
    reader = token_files.FileReader(files.first()["base"])
    assert reader.file.schema.field("ids").type.list_size == 64 and not next(reader.tokens(0, 3)).flags.owndata


def test_token_pieces_match_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), token_files.Encoder(path)
    rnd = random.Random(3)
    texts = ["", "x" * 3000, "WE'LL don't. İ ΣΑΣ ſ n't's <|endoftext|>y <|start"] + ["".join(rnd.choice("abÉ é\n'ſ\tz1.,<|> ́日") for _ in range(150)) for _ in range(200)]
    texts += ["".join(rnd.choice("aBÉ éœÿŸžſ\n'ſ\tŉz1.,&×÷ªŁ´-") for _ in range(150)) for _ in range(200)] + ["it's 'S 'll''ve $'s 12.5%\r\n..." + c for c in map(chr, range(0x20, 0x180))]
    assert own.plain
    for _ in range(2):
        for t, blob in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(blob, own.type).tolist() == library.encode(t, add_special_tokens=False).ids
    other = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))  # another form: all texts go to the library
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t, blob in zip(texts[:50], other.encode(texts[:50]), strict=True):
        assert np.frombuffer(blob, other.type).tolist() == whole.encode(t, add_special_tokens=False).ids


def test_quality_rules(spark, edge_docs, labels):
    found = {r["doc_id"]: r for r in quality_rules.judge(edge_docs, labels).collect()}
    assert found[1]["kept"] and not found[4]["kept"] and found[4]["n_words"] == 0
    for d, t in plain(edge_docs):
        w = WORDS(t or "")
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        places = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        if d not in (8, None):
            assert (found[d]["n_words"], found[d]["word_chars"], found[d]["n_repeat_words"]) == (len(w), sum(map(len, w)), len(places))


def test_exact_binomial_bounds(spark):
    from math import comb

    df = spark.createDataFrame([(k, n) for n in (1, 30, 400) for k in (0, 1, 5) if k <= n], "k long, n long")
    for k, n, p in df.select("k", "n", quality_rules.binomial_cdf(F.col("k"), F.col("n"), 0.01)).collect():
        assert p == pytest.approx(sum(comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1)))


def test_certified_cutoffs_reject_bad_and_keep_good(spark):
    ship(spark)
    good = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en") for i in range(1500)]
    bad = [(5000 + i, " ".join(f"w{i}y{j}###" for j in range(60)), "en") for i in range(50)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, int(d < 5000), 0) for d, _, _ in good + bad], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality_rules.judge(docs, labels).where("kept").collect()}
    assert kept == {d for d, _, _ in good}


def test_the_bound_holds_for_the_verdict_in_every_stratum(spark):
    """Each signal alone turns away 0.2 % of the good rows, which all together can't certify; label rows are repeated."""
    ship(spark)
    words = lambda i: [f"w{i}x{j}" for j in range(60)]
    odd = [lambda w: [*w[:-8], *["###"] * 8], lambda w: [*w, *w[:12]], lambda w: [x + "y" * 20 for x in w]]
    docs, known = [], []
    for lang in ("en", "de", None):
        for i in range(2500):
            w, kind = words(i), i // 5
            good = not (kind < 3 or 2400 <= i)
            w = odd[kind](w) if kind < 3 else odd[0](odd[1](w)) if 2400 <= i else w
            docs.append((len(docs), " ".join(w), lang))
            known += [(docs[-1][0], int(good or kind < 3), 0)] * (1 + i % 2)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    signals = quality_rules.documents_signals(df).cache()
    settings = quality_rules.certified_settings(signals, labels).collect()
    assert len(settings) == 3
    quality, kept = {d: q for d, q, _ in known}, {r["doc_id"]: r["kept"] for r in quality_rules.judge(df, labels).collect()}
    failed = {r["doc_id"] for r in signals.where(quality_rules.base_failed()).collect()}
    for lang in ("en", "de", None):
        good = [d for d, _, x in docs if x == lang and quality[d] and d not in failed]
        bad = [d for d, _, x in docs if x == lang and not quality[d]]
        assert sum(not kept[d] for d in good) == 10 and not any(kept[d] for d in bad)


def test_mixing(spark, edge_docs):
    rows = mixing.assign_positions(edge_docs).collect()
    sizes = {(r["doc_id"], r["size"]) for r in rows}
    assert sizes == {(d, len(WORDS(t or ""))) for d, t in plain(edge_docs)} and len(rows) == edge_docs.count()
    taken, target = collections.Counter(), {}
    for r in rows:
        t = sum(c["taken"] for c in r["copies"])
        assert 0 <= t <= 2 * r["size"]
        taken[r["source"]] += t
        target[r["source"]] = r["target"]
    total = sum(s for _, s in ((r["doc_id"], r["size"]) for r in rows))
    assert sum(target.values()) == pytest.approx(1.5 * total)
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert bag(map(str, rows)) == bag(map(str, mixing.assign_positions(edge_docs).collect()))
    mixed = mixing.mixed_documents(edge_docs)
    assert mixed.columns == edge_docs.columns
    assert mixed.count() == mixing.training_order(edge_docs).count() == sum(c["whole"] for r in rows for c in r["copies"])


def test_targets_are_a_water_level(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 50), (None, 400)], "source string, size long")
    found = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    weight, size = {"a": 3, "b": 1, "c": 2, None: 3}, {"a": 10, "b": 1000, "c": 50, None: 400}
    left, open_, target = 1.5 * 1460, set(size), dict.fromkeys(size, 0.0)
    while left > 1e-9:
        share = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += share * weight[s]
            if target[s] > 2 * size[s]:
                left += target[s] - 2 * size[s]
                target[s] = 2.0 * size[s]
                open_.discard(s)
    assert found == pytest.approx(target)


def vectors(spark, n=600, width=16):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((n, width)).astype(np.float32)
    x[50:80] = x[50]
    rows = [(i, x[i].tolist(), "extra") for i in range(n)]
    odd = [(n, None), (n + 20, [0.0] * width), (n + 40, [float("nan")] * width), (n + 60, [None, *[1.0] * (width - 1)]), (n + 80, [1.0]), (None, x[0].tolist()), (n + 100, [])]
    return x, spark.createDataFrame(rows + [(i, v, "extra") for i, v in odd], "vec_id long, embedding array<float>, norm string")


def test_nearest_neighbours(spark):
    ship(spark)
    x, df = vectors(spark)
    found = ann.search(df, df.where("vec_id % 20 = 0"))
    near = collections.defaultdict(dict)
    for r in found.collect():
        near[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    exact = x.astype(float)
    hits = 0
    assert sorted(near) == list(range(0, 600, 20))
    for q, ranked in near.items():
        scores = (exact * exact[q]).sum(1)
        scores[q] = -np.inf
        order = np.lexsort((np.arange(600), -scores))[:20]
        assert sorted(ranked) == list(range(1, 21))
        hits += len({v for v, _ in ranked.values()} & set(order.tolist()))
        assert all(s == pytest.approx(scores[v]) for v, s in ranked.values())
        assert [v for _, v in sorted((-s, v) for v, s in ranked.values())] == [ranked[i][0] for i in range(1, 21)]
    assert hits / (20 * len(near)) >= 0.9
    few = ann.search(df.where("vec_id < 5"), df.where("vec_id = 0")).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2, 3, 4]


def test_neighbours_of_repeated_rows_and_by_distance(spark, monkeypatch):
    """Repeated queries each have a result, copies never fill the short list, chunks and blocks are as good as one."""
    ship(spark)
    x, df = vectors(spark)
    x = x.astype(float)
    monkeypatch.setattr(ann, "QUERY_BYTES", 2000)
    some = df.where("vec_id IN (0, 50)")
    found = ann.search(df.unionByName(df.where("vec_id = 60")), some.unionByName(some), shortlist=30, by_distance=True).collect()
    assert collections.Counter(r["query_id"] for r in found) == {0: 40, 50: 40}
    assert sorted(r["vec_id"] for r in found if r["query_id"] == 50) == sorted(2 * [*range(51, 70), 60])
    near = sorted((((x[i] - x[0]) ** 2).sum(), i) for i in range(1, 600))
    scores = {r["vec_id"]: -r["score"] for r in found if r["query_id"] == 0}
    assert len(scores.keys() & {i for _, i in near[:20]}) >= 18 and all(s == pytest.approx(((x[i] - x[0]) ** 2).sum()) for i, s in scores.items())
    assert sum(r["score"] == 0 for r in found) == 40


@pytest.mark.parametrize("block, common", [(64, 0.03), (4, 0.03), (4, 0.15), (4, 2)])
def test_block_max_index_is_exact(monkeypatch, block, common):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    monkeypatch.setattr(toxicity, "COMMON", common)
    rnd = np.random.default_rng(6)
    packed = []
    for _ in range(400):
        terms = np.sort(rnd.choice(30, rnd.integers(0, 6), replace=False))
        packed.append(np.stack([terms, rnd.integers(1, 4, len(terms))], 1).astype("<u4").tobytes())
    index = toxicity.Index(packed, rnd.integers(0, 2, 400).tolist(), list(range(400)), rnd.integers(1, 300, 30), 1000)
    for index in (index, pickle.loads(pickle.dumps(index))):
        dense = np.zeros((400, 30))
        for i in range(400):
            terms, w = index.vector(index.packed(i))
            dense[i, terms] = w
        asked = [i for i in range(0, 400, 3) if index.packed(i)]
        for i, near in zip(asked, index.nearest([index.packed(i) for i in asked], but=asked), strict=True):
            cosine = np.round(dense @ dense[i], 12)
            cosine[i] = -1
            order = [j for j in np.lexsort((index.ids, -cosine))[: toxicity.NEIGHBOURS] if cosine[j] > 0]
            assert [r for _, r in near] == order


def test_tokens_are_runs_of_word_characters():
    rnd = random.Random(4)
    texts = ["", None, "Ünïcode—dash “quotes” x_y 1a2 日本語。次 ٣٤ a\u0301b", "A\x85b\xa0c\x1cd"] + ["".join(chr(rnd.randrange(1, 0x3000)) for _ in range(300)) for _ in range(50)]
    for t in texts:
        assert [w.decode() for w in toxicity.tokens(t)] == re.findall(r"\w+", (t or "").lower())


def test_toxicity_on_held_out_rows(spark):
    ship(spark)
    rnd = random.Random(8)
    clean = [f"word{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(900):
        toxic = int(rnd.random() < 0.2)
        w = [rnd.choice(clean) for _ in range(40)]
        for _ in range(3 * toxic):
            w[rnd.randrange(40)] = rnd.choice(["Nasty,", "vile", "horrid."])
        docs.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    df, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_documents(df, known).collect()}
    held = [(scores[i] >= 0.7, t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(a == bool(t) for a, t in held) / len(held) > 0.97 and all(0 <= s <= 1 for s in scores.values())
    kept = {r["doc_id"] for r in toxicity.drop_toxic(df, known).collect()}
    assert kept == {i for i, s in scores.items() if s < 0.7}


def test_toxicity_uses_all_terms_of_the_examples(spark):
    """Few examples, whose insults are each too rare to stand out alone: neighbours by brute force over all terms."""
    ship(spark)
    rnd = random.Random(3)
    docs, known = [], []
    for i in range(90):
        toxic = int(i % 6 == 0)
        w = [f"word{rnd.randrange(60)}" for _ in range(20)] + rnd.sample([f"insult{j}" for j in range(8)], 3) * toxic
        docs.append((i, " ".join(w)))
        known.append((i, 1, toxic))
    rows = toxicity.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(known, "doc_id long, quality int, toxic int")).collect()
    learnt = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 3 != 1]
    counts = [collections.Counter(t.split()) for _, t in docs]
    weight = {}
    n1 = sum(known[i][2] for i in learnt)
    n0 = len(learnt) - n1
    for t in {t for i in learnt for t in counts[i]}:
        b = sum(known[i][2] for i in learnt if t in counts[i])
        a = sum(t in counts[i] for i in learnt) - b
        chi = (n0 + n1) * (a * (n1 - b) - b * (n0 - a)) ** 2 / (n0 * n1 * (a + b) * (n0 + n1 - a - b))
        weight[t] = (np.log((1 + len(docs)) / (1 + sum(t in c for c in counts))) + 1) * np.sqrt(1 + chi)
    vectors = [{t: (1 + np.log(n)) * weight[t] for t, n in c.items() if t in weight} for c in counts]
    norms = [np.sqrt(sum(x * x for x in v.values())) for v in vectors]
    for r in rows:
        v = vectors[r["doc_id"]]
        cosine = {i: sum(x * vectors[i].get(t, 0) for t, x in v.items()) / norms[r["doc_id"]] / norms[i] for i in learnt}
        assert [e["cosine"] for e in r["evidence"]] == pytest.approx(sorted(cosine.values(), reverse=True)[: toxicity.NEIGHBOURS])
        assert all(e["cosine"] == pytest.approx(cosine[e["doc_id"]]) for e in r["evidence"])

    # the whole score by brute force: votes, their calibration on the examples (each without itself), and the step they fall on
    def vote(i, without):
        near = sorted((-round(sum(x * vectors[j].get(t, 0) for t, x in vectors[i].items()) / norms[i] / norms[j], 12), j) for j in learnt if j != without)
        near = [(1 / (toxicity.CLOSEST + 1 + c), known[j][2]) for c, j in near[: toxicity.NEIGHBOURS] if c < 0]
        return (sum(w * y for w, y in near) + n1 / len(learnt)) / (sum(w for w, _ in near) + 1)

    own = sorted((round(vote(i, i), 9), known[i][2]) for i in learnt)
    values = sorted({v for v, _ in own})
    of = [[y for v, y in own if v == x] for x in values]
    mean = lambda a, b: sum(map(sum, of[a : b + 1])) / sum(map(len, of[a : b + 1]))
    fitted = [max(min(mean(a, b) for b in range(i, len(of))) for a in range(i + 1)) for i in range(len(of))]
    for r in rows:
        at = max([i for i, v in enumerate(values) if v <= round(vote(r["doc_id"], None), 9)], default=0)
        pool = [y for f, ys in zip(fitted, of, strict=True) if f == pytest.approx(fitted[at]) for y in ys]
        assert r["score"] == pytest.approx((sum(pool) + 0.5) / (len(pool) + 1))


def test_toxicity_edge_cases(spark, edge_docs, labels):
    found = toxicity.score_documents(edge_docs, labels).collect()
    assert len(found) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.drop_toxic(edge_docs, labels).columns == edge_docs.columns


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">x</a></li></ul></nav>
<!-- ad --><div class="ad">Buy</div><div id="cookie-notice">We use cookies</div><article><h1>{0} &amp; more</h1><p><b>Bold{0}</b>ly said<br>new
line<p>Second &lt;p&gt; {0}</p><form><input><label>Name</label></form></p></article><aside>More</aside><section class="comments"><p>A comment {0}</p></section>
<footer>&copy; f</footer></body></html>"""


def test_main_texts(spark):
    ship(spark)
    pages = [(i, f"http://h{i % 2}.example/p{i}", PAGE.format(f"n{i}"), "k", 1) for i in range(6)]
    plain_pages = [(10 + i, "http://plain.example/", f"<body><div class='menu'>Home</div><div><p>Story {i} goes on</p></div><div class=footer>f</div>", "k", 1) for i in range(3)]
    odd = [(20, None, None, None, None), (21, "http://x", "", "k", 2), (22, "http://h0.example/", "<article><p>cut &am", "k", 3), (None, "x", "just text", "k", 4)]
    df = spark.createDataFrame(pages + plain_pages + odd, "page_id long, url string, html string, host string, container int")
    found = {r["page_id"]: r["text"] for r in html_extract.main_texts(df).collect()}
    for i in range(6):
        assert found[i] == f"n{i} & more Boldn{i}ly said new line Second <p> n{i}"
    assert [found[10 + i] for i in range(3)] == [f"Story {i} goes on" for i in range(3)]
    assert (found[20], found[21], found[22], found[None]) == ("", "", "cut &am", "just text")


def test_names_that_only_hold_a_word_of_the_list_keep_their_text(spark):
    ship(spark)
    bodies = [
        '<body class="has-sidebar"><p>{}</p></body>', '<body class="sidebar"><article class="post comments"><p>{}</p></article></body>', '<body><article class="post comments-open"><p>{}</p></article></body>',
        '<body><div id="content-with-nav"><p>{}</p></div></body>', '<body><div data-id="menu"><p>{}</p></div></body>', '<body><div><p>{}</p></div><div class="big Footer">x</div></body>',
    ]
    pages = [(10 * i + j, f"http://n{i}.example/{j}", b.format(f"Text {j} here")) for i, b in enumerate(bodies) for j in range(3)]
    for r in html_extract.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect():
        assert r["text"] == f"Text {r['page_id'] % 10} here"


def article_blocks(page):
    return [t for _, _, t, _ in html_extract.blocks_of(page)]


def test_text_after_self_closed_and_custom_elements():
    for part in ("<svg width='1'/>", "<svg/>", "<math />", "<video-js id=x></video-js>", "<svg><path d='x'/><title>no</title></svg>", "<script>no</script>", "<script>a<b</SCRIPT >"):
        assert article_blocks(f"<article><p>one {part}</p><p>two</p></article>") == ["one", "two"]


def test_broken_markup_loses_no_text():
    assert article_blocks("<p title=it's>It is</p><p>if a<b then</p><p>1 < 2 &lt; 3</p><p data-x='<b>'>q</p>") == ["It is", "if a<b then", "1 < 2 < 3", "q"]
    assert article_blocks("<p>a <a href='x>y</p><p>b</p>") == ["a y", "b"]
    assert article_blocks("<div><svg><g></div><p>after an open svg</p>") == ["after an open svg"]
    assert article_blocks("<p>x</p><!-- open comment <p>no</p>") == ["x"]
    assert html_extract.main_text(html_extract.blocks_of("<article><p>see <a class='related'>this one</a> too</p></article>"), None) == "see this one too"


def test_markup_is_read_in_one_pass():
    start = time.time()
    for page in ("<a " * 100_000, "<a x='" * 100_000, "<!-- " * 100_000, "<script>" * 100_000, "</x" * 100_000, "<p>" * 20_000 + "text"):
        html_extract.blocks_of(page)
    rnd = random.Random(5)
    long = ["".join(f"<div class={rnd.choice('abcdefgh')}><h{rnd.randrange(1, 7)}>t{i} {rnd.random()}</h2></div>" for i in range(10_000)) for _ in range(2)]
    first, second = (html_extract.stream_of(html_extract.blocks_of(x)) for x in long)
    assert len(html_extract.align(first, second)) <= html_extract.LONGEST_WRAPPER
    assert time.time() - start < 20


def pages_of(*bodies):
    return [html_extract.blocks_of(f"<html><body>{b}</body></html>") for b in bodies]


def form_of(pages):
    return html_extract.decisions(html_extract.merged([html_extract.stream_of(p) for p in pages]))


def test_the_wrapper_decides_where_no_element_is_called_article():
    """One page has more text beside its story than in it: only the other pages of the host tell which is which."""
    side = lambda i: f"<p>{f'aside {i} ' * (40 if i == 3 else 1)}</p>"
    bodies = [f"<div id=left>{side(i)}</div><div id=mid><h2>Head {i}</h2><p>{f'story {i} ' * 20}</p><p>more of {i}</p><div>All rights kept</div></div>" for i in range(60)]
    pages = pages_of(*bodies)
    form = form_of(pages)
    assert form["box"] == "/html/body/div.mid"
    for i, page in enumerate(pages):
        assert html_extract.main_text(page, form) == f"Head {i} {' '.join([f'story {i}'] * 20)} more of {i}"
    assert "aside" in html_extract.main_text(pages[3], None) and "All rights kept" in html_extract.main_text(pages[3], None)


def test_containers_lose_no_part_of_the_text():
    both = pages_of(*[f"<div class=intro><p>{f'intro {i} ' * 10}</p></div><div class=body><p>{f'body {i} ' * 30}</p></div>" for i in range(3)])
    assert all("intro" in html_extract.main_text(p, form_of(both)) and "body" in html_extract.main_text(p, form_of(both)) for p in both)
    card = pages_of(*[f"<main><div>{f'long {i} ' * 50}</div><article class=card>teaser {i}</article></main>" for i in range(3)])
    assert all("long" in html_extract.main_text(p, form_of(card)) for p in card)
    form = form_of(pages_of(*[f"<div class=post><p>{f'post {i} ' * 30}</p></div>" for i in range(6)]))
    assert html_extract.main_text(pages_of("<table><tr><td>another form</td></tr></table>")[0], form) == "another form"
    named = "<div class='post-sidebar-layout'><p>story {0}</p><p>goes on {0}</p><div class='related-posts'><p>other {0}</p></div><div id=cookie-notice>we use {0}</div></div>"
    compound = pages_of(*[named.format(f"{i} " * 9) for i in range(3)])
    assert html_extract.main_text(compound[1], form_of(compound)) == f"story {' '.join('1' * 9)} goes on {' '.join('1' * 9)}"
    inside = pages_of(*[f"<div class=comments><p>{f'all {i} ' * 30}</p></div><div class=menu>m{i}</div>" for i in range(3)])
    assert html_extract.main_text(inside[0], form_of(inside)) == " ".join(["all 0"] * 30)


def test_wrapper_alignment():
    wrapper = html_extract.merged([html_extract.stream_of(p) for p in pages_of("<h1>x</h1><p>1</p><p>2</p><div>c</div>", "<h1>y</h1><b>!</b><p>3</p><div>c</div>")])
    assert html_extract.expression(wrapper) == "/html/body/h1# (/html/body=)? (/html/body/p#)+ /html/body/div="
    places = lambda *names: [[n, False, False, 1, 1, 0, [1], []] for n in names]
    found = html_extract.align(places("h1", "p", "f"), places("h1", "ad", "p", "p", "f"))
    assert html_extract.expression(found) == "h1= (ad=)? (p=)+? f="


def test_forms_of_hosts_beyond_the_broadcast_bound(spark, monkeypatch):
    ship(spark)
    pages = spark.createDataFrame([(i, f"http://h{min(i, 9)}.example/{i}", f"<div><p>Text {i}</p></div>") for i in range(30)], "page_id long, url string, html string")
    monkeypatch.setattr(html_extract, "HEAVY", 3)
    assert sorted((r["page_id"], r["text"]) for r in html_extract.main_texts(pages).collect()) == [(i, f"Text {i}") for i in range(30)]


def test_empty_tables(spark, edge_docs, labels):
    none, no_labels = edge_docs.limit(0), labels.limit(0)
    path, words = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    empty = [
        ngram_join.jaccard_groups(none), substring_dedup.marked(none, True), toxicity.score_documents(none, no_labels), token_files.read_documents(token_files.write_files(none, words)),
        html_extract.main_texts(pages), line_dedup.dedup_lines(none), quality_rules.judge(none, no_labels), mixing.training_order(none), bpe.round_trip(none, path),
        ann.search(*[spark.createDataFrame([], "vec_id long, embedding array<float>")] * 2),
    ]
    assert [df.count() for df in empty] == [0] * 10
    assert toxicity.score_documents(edge_docs, no_labels).where("score > 0").count() == 0


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_against_duckdb(spark, name):
    if not Path(SMALLEST).exists():
        pytest.skip("no tables here")
    ship(spark)
    base = duckdb.connect()
    for p in Path(SMALLEST).glob("*.parquet"):
        base.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, expected = queries()[name](spark, SMALLEST), base.sql(oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    ours, theirs = got.select(*columns).collect(), expected.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    assert bag(ours) == bag(theirs)


def test_pages_of_the_smallest_tables(spark):
    if not Path(SMALLEST).exists():
        pytest.skip("no tables here")
    ship(spark)
    df = spark.read.parquet(f"{SMALLEST}/pages.parquet")
    pages = {r["page_id"]: r["html"] for r in df.collect()}
    for r in html_extract.main_texts(df).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        assert r["text"] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body))).split())
