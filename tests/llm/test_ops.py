"""Each operator against a brute-force version, an exact round trip or held-out labels, with nulls, empties, ties, repeats and clashing columns."""

import itertools
import math
import re
import tracemalloc
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tessera.llm import _text, fingerprint, language_id, mixing, ngram_join, quality, secrets_crf, sentence_dedup, sentencepiece_lattice, toxicity, warc

SF = "/root/testdata/sf0.01"
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
TEXTS = [
    None, "", "   \n\t ", "one", "One", "two words", " ".join(BASE), " ".join(BASE), " ".join(BASE).upper(), " ".join(BASE[:-1]), " ".join(BASE[2:] + ["new"]),
    "x " * 40, "x " * 41, "Élan café naïve été. " * 3, "a line\na line\nanother line\n" * 4, " ".join(BASE[:12] + BASE[:12]), " ".join(f"w{k % 977}" for k in range(30000)), "!!! ??? ...",
]


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns have the names that the operators use themselves; the last document's row is there twice, and one row has no doc_id."""
    rows = [(k + 1, t) for k, t in enumerate(TEXTS)]
    rows += [rows[-1], (None, "no id")]
    return spark.createDataFrame([(i, t, "en", "s" if i is None or i % 2 else None, len(t or ""), 1, 2, 3, 4, 5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, id int, a int, size int, h int, tokens int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def words(t):
    return re.findall(r"[0-9a-z_\u0080-\U0010ffff]+", (t or "").lower())


def grams(t, n=3):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def near_classes(pairs, ids):
    root = {i: i for i in ids}
    for _ in root:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    return {i: (root[i], sum(i in p for p in pairs)) for i in root}


def test_ngram_join_of_dense_groups(spark):
    """Groups of near copies that share n-grams with each other too, by both ways; the SQL has the same rows."""
    rng = np.random.default_rng(8)
    seeds = [[f"v{x}" for x in rng.integers(0, 60, 50)] for _ in range(3)]
    texts = []
    for k in range(90):
        t = list(seeds[k % 3])
        for _ in range(int(rng.integers(0, 6))):
            t[int(rng.integers(0, 50))] = f"u{rng.integers(0, 40)}"
        texts.append(" ".join(t))
    sets = [grams(t) for t in texts]
    want = {(i, j): x for i, j in itertools.combinations(range(90), 2) if (x := len(sets[i] & sets[j]) / len(sets[i] | sets[j])) >= 0.5}
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for how in ({}, {"held_docs": 2}, {"held_grams": 10}):
        assert {(r[0], r[1]): r[2] for r in ngram_join.all_pairs(ngram_join.ngram_jaccard_join(d, **how)).collect()} == pytest.approx(want)
        assert {r.doc_id: (r.class_id, r.links) for r in ngram_join.near_classes(d, **how).collect()} == near_classes(want, range(90))
    import duckdb

    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": range(90), "text": texts}))
    assert {r[0]: r[1:] for r in con.execute(ngram_join.ORACLE).fetchall()} == near_classes(want, range(90))


def test_ngram_join_gathers_by_bucket():
    """More fragments give no row for each document and fragment; documents that share half of their n-grams come with all that they share."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 9, 200)) if k % 3 else " ".join(f"u{k}x{x}" for x in range(50)) for k in range(300)]
    rows, sets = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(texts)], names=["doc_id", "text"]), [grams(t) for t in texts]
    many = {g for g, n in Counter(g for s in sets for g in s).items() if n > 1}
    for bits in (2, 5):
        packed = pa.Table.from_batches(list(ngram_join._spread(3, bits)(iter([rows]))))
        parts = [b for f in range(1 << bits) for b in ngram_join._shared(4)(iter(packed.filter(pc.equal(packed["frag"], f)).to_batches()))]
        shared = pa.Table.from_batches(parts)
        assert shared.num_rows <= 4 << bits
        got = {}
        for k in range(4):
            for b in ngram_join._covered(0.5)(iter(shared.filter(pc.equal(shared["bucket"], k)).to_batches())):
                got |= {d: (n, len(g) // 8) for d, n, g in zip(b["doc_id"].to_pylist(), b["size"].to_pylist(), b["grams"].to_pylist())}
        assert got == {k: (len(s), len(s & many)) for k, s in enumerate(sets) if 2 * len(s & many) >= len(s)}


def test_ngram_join_of_many_buckets():
    """However many buckets prefixes are spread over, no near pair of two blocks is lost, and what moves stays below what the entries take if each were alone."""
    rng = np.random.default_rng(1)
    sets = [set((rng.zipf(1.3, int(rng.integers(2, 400))) % 3000).tolist()) for _ in range(200)]
    sets += [set(rng.permutation(sorted(s))[: max(1, int(len(s) * rng.uniform(0.4, 1)))].tolist()) | set(rng.integers(0, 3000, 9).tolist()) for s in sets]
    freq = Counter(x for s in sets for x in s)
    for threshold in (0.5, 0.8):
        rows = []
        for k, s in enumerate(sets):
            own = sorted((x for x in s if freq[x] > 1), key=lambda x: (freq[x], x))
            if len(own) >= (need := math.ceil(len(s) * threshold)):
                rows.append((k, len(s), k // 2, len(own) - need + 1, np.array(own, np.int64).tobytes()))
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=["doc_id", "size", "block", "prefix", "grams"])
        want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if i // 2 != j // 2 and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold}
        for buckets in (1, 60):
            routed = pa.Table.from_batches(list(ngram_join._routed(buckets)(iter([batch.slice(0, 100), batch.slice(100)]))))
            assert sum(len(x) for c in routed.column_names[1:] for x in routed[c].to_pylist()) <= sum(r[3] * (max(16, len(r[4]) / 16) + 48) for r in rows)
            got = set()
            for k in range(buckets):
                for b in ngram_join._told(threshold)(iter(routed.filter(pc.equal(routed["bucket"], k)).to_batches())):
                    got |= set(zip(b["a"].to_pylist(), b["b"].to_pylist()))
            assert want and want <= got


def test_similarity_never_passes_one(spark):
    """Rows of one doc_id with different texts: the longest counts."""
    d = spark.createDataFrame([(1, "a b c d e"), (1, "p q r"), (2, "a b c d e"), (2, None), (3, "p q r")], "doc_id long, text string")
    assert [tuple(r) for r in ngram_join.ngram_jaccard_join(d).collect()] == [(1, 2, 1.0)]
    assert {tuple(r) for r in ngram_join.near_classes(d).collect()} == {(1, 1, 1), (2, 1, 1), (3, 3, 0)}


def test_ngram_join(docs, none):
    sets = {i + 1: grams(t) for i, t in enumerate(TEXTS)}
    for threshold in (0.5, 0.8):
        want = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in itertools.combinations(sets, 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold}
        got = {(r[0], r[1]): r[2] for r in ngram_join.all_pairs(ngram_join.ngram_jaccard_join(docs, threshold=threshold)).collect()}
        assert got == pytest.approx(want)
        # the way of components that no task can hold
        assert {(r[0], r[1]): r[2] for r in ngram_join.all_pairs(ngram_join.ngram_jaccard_join(docs, threshold=threshold, held_docs=1)).collect()} == pytest.approx(want)
        classes = near_classes(want, range(1, len(TEXTS) + 1))
        for held in (20_000, 1):
            assert {r.doc_id: (r.class_id, r.links) for r in ngram_join.near_classes(docs, threshold=threshold, held_docs=held).collect()} == classes
    assert ngram_join.ngram_jaccard_join(none).collect() == [] and ngram_join.near_classes(none).collect() == []
    kept = ngram_join.keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(len(TEXTS)) == 2 and None in ids and {1, 2, 3, 7} <= set(ids) and not {8, 9, 10} & set(ids)


def test_every_pair_is_registered(spark, tmp_path):
    """Four equal copies beside two near ones: all pairs, those of two copies and of a copy and a near copy too; the same rows from the SQL."""
    texts = [" ".join(BASE)] * 3 + [" ".join(BASE).upper(), " ".join(BASE[:-1]), " ".join(BASE[1:]), "something else altogether here"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = [grams(t) for t in texts]
    want = {(i, j): x for i, j in itertools.combinations(range(len(texts)), 2) if (x := len(sets[i] & sets[j]) / len(sets[i] | sets[j])) >= 0.5}
    got = {(r[0], r[1]): r[2] for q in __spark_entry__.queries().items() if q[0] == "op1_all_pairs" for r in q[1](spark, str(tmp_path)).collect()}
    assert len(want) == 15 and got == pytest.approx(want)
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert {(r[0], r[1]): r[2] for r in con.execute(__spark_entry__.oracle_sql()["op1_all_pairs"]).fetchall()} == pytest.approx(want)


def test_quality(docs, none):
    got = {r.doc_id: r for r in quality.repetition(docs).collect()}
    for i, t in enumerate(TEXTS, 1):
        w = re.findall(r"[^ \t\n\f\r\x0b]+", t or "")
        total = sum(map(len, w))
        assert got[i].chars == total
        for n in quality.LENGTHS:
            seen, cover = set(), set()
            for k in range(len(w) - n + 1):
                g = tuple(w[k : k + n])
                cover |= set(range(k, k + n)) if g in seen else set()
                seen.add(g)
            assert got[i][f"dup_{n}"] == pytest.approx(sum(len(w[k]) for k in cover) / max(1, total))
        seen, c = set(), 0
        for line in (t or "").split("\n"):
            line = line.strip(" \t\r\f\x0b")
            c += len("".join(line.split())) if line in seen else 0
            seen.add(line)
        assert got[i].dup_lines == pytest.approx(c / max(1, total))
    assert got[2].keep and not got[15].keep
    assert quality.repetition(none).collect() == []


def test_language_held_out(spark, docs, none):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    train, held = d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1 AND length(text) > 200")
    model = language_id.fit(train)
    out = held.select("doc_id", "text", "lang").toPandas()
    buf, offs = _text.flat(pa.array(out["text"]))
    got = np.array([*model.languages, language_id.UNKNOWN])[language_id.classify(model, buf, offs)[0]]
    assert (got == out["lang"].to_numpy()).mean() > 0.9
    rows = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert len(rows) == len(TEXTS) and rows[1].language == rows[2].language == "und" and rows[1].windows == 0 and rows[7].language == "en"
    assert language_id.identify(none).collect() == []


def test_language_network_is_the_plain_convolution(spark, docs):
    """Language, confidence and windows of each document by loops over windows, places and filters."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(d, 20, 1)
    texts = {1: "", 2: "x", 3: "é" * 300, 4: "the quick " * 60, 5: "a" * 256, 6: "b" * 257}
    got = {r.doc_id: r for r in spark.createDataFrame(list(texts.items()), "doc_id long, text string").mapInArrow(language_id._run(model), "doc_id long, language string, confidence double, windows int").collect()}
    for i, t in texts.items():
        raw = t.encode()
        parts = [raw[k : k + 256] for k in range(0, len(raw), 256)]
        assert got[i].windows == len(parts)
        if not parts:
            assert (got[i].language, got[i].confidence) == ("und", 0.0)
            continue
        total = np.zeros(len(model.languages))
        for part in parts:
            x = np.frombuffer(part.ljust(256, b"\0"), np.uint8)
            h = []
            for filters, bias in zip(model.filters, model.biases):
                w = len(filters)
                h += [max(0.0, max(sum(model.embedding[x[p + k]] @ filters[k][:, f] for k in range(w)) for p in range(256 - w + 1)) + bias[f]) for f in range(len(bias))]
            z = model.weights @ np.array(h) + model.bias
            total += (z - z.max() - np.log(np.exp(z - z.max()).sum())) * len(part)
        mean = total / len(raw)
        p = np.exp(mean - mean.max()) / np.exp(mean - mean.max()).sum()
        assert got[i].language == model.languages[int(p.argmax())] and got[i].confidence == pytest.approx(p.max(), abs=1e-4)


def brute_repeats(texts, least=sentence_dedup.MIN_WORDS):
    runs = []
    for i, t in texts:
        parts = [re.findall(r"[^ \t\n\f\r\x0b]+", x.lower()) for x in re.split(r"(?<=[.!?])\s+|\n", t or "")]
        parts = [p for p in parts if p]
        found = set()
        for k in range(len(parts)):
            j = next((j for j in range(k, len(parts)) if sum(map(len, parts[k : j + 1])) >= least), None)
            b = next((b for b in range(k, -1, -1) if sum(map(len, parts[b : k + 1])) >= least), None)
            found |= ({(k, j)} if j is not None else set()) | ({(b, k)} if b is not None else set())
        runs += [(tuple(w for p in parts[a : z + 1] for w in p), i, a, z) for a, z in found]
    first = {}
    for g, i, a, _ in sorted(runs, key=lambda r: r[1:3]):
        first.setdefault(g, (i, a))
    return {(i, a, z) for g, i, a, z in runs if first[g] != (i, a)}


def test_sentence_dedup(spark, docs, none):
    rng = np.random.default_rng(1)
    sentence = lambda: " ".join(rng.choice(BASE, int(rng.integers(3, 30)))) + "."
    shared = [[sentence() for _ in range(5)] for _ in range(3)]
    texts = [(k, " ".join([sentence(), *(shared[k % 3] if k % 4 else []), sentence()])) for k in range(24)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    marks = brute_repeats(texts)
    assert marks and {tuple(r) for r in sentence_dedup.repeated_runs(d).collect()} == marks
    got = {r.doc_id: r for r in sentence_dedup.remove_repeats(d).collect()}
    for i, t in texts:
        gone = {k for x, a, z in marks if x == i for k in range(a, z + 1)}
        assert got[i].removed == len(gone) and got[i].text.split() == " ".join(s for k, s in enumerate(re.split(r"(?<=\.) ", t)) if k not in gone).split()
    rows = sentence_dedup.remove_repeats(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    by = {r.doc_id: r for r in rows}
    assert by[1].text is None and by[2].text == "" and by[7].removed == 0 and by[8].text == by[9].text == "" and by[18].text == TEXTS[17]
    assert sentence_dedup.remove_repeats(none).collect() == []
    # rows of one doc_id with different texts: each loses what lesser doc_ids have, and no other's sentences
    long = [" ".join(f"w{a}{k}" for k in range(25)) + "." for a in "abcdef"]
    odd = spark.createDataFrame([(1, long[0]), (2, " ".join(long)), (2, f"short. {long[0]}"), (3, " ".join(long[1:3]) + " tail.")], "doc_id long, text string")
    got = sorted((r.doc_id, r.text.strip(), r.removed) for r in sentence_dedup.remove_repeats(odd).collect())
    assert got == sorted([(1, long[0], 0), (2, " ".join(long[1:]), 1), (2, "short.", 1), (3, "tail.", 2)])
    twice = spark.createDataFrame([(1, f"Start. {long[0]} Middle. {long[0]} End.")], "doc_id long, text string")
    assert sentence_dedup.remove_repeats(twice).first().text == f"Start. {long[0]} Middle. End."


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    for _ in range(50):
        em, trans = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
        total = lambda y: sum(em[k, t] for k, t in enumerate(y)) + sum(trans[a, b] for a, b in itertools.pairwise(y))
        assert tuple(secrets_crf.viterbi(em, trans)) == max(itertools.product(range(3), repeat=5), key=total)
        model = secrets_crf.Model(None, None, None, trans)
        em[::2, 0] += 9
        assert secrets_crf.decode(model, em, np.zeros(5, int)).tolist() == secrets_crf.viterbi(em, trans)


def test_secrets(spark, docs, none):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    found = secrets_crf.find_secrets(d).toPandas()
    texts = {r.doc_id: r.text for r in d.select("doc_id", "text").collect()}
    planted = {(i, m[1]) for i, t in texts.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t or "")}
    assert planted and planted <= set(zip(found.doc_id, found.secret))
    assert all(texts[r.doc_id][r.start : r.end] == r.secret for r in found.itertuples())
    assert len(set(found.doc_id) - {i for i, _ in planted}) <= 0.01 * len(texts)
    key = spark.createDataFrame([(1, 'é api_key = "' + "0123456789abcdef" * 2 + 'deadbeef" ok', 7)], "doc_id long, text string, n_chars long")
    text, size = secrets_crf.redact(key).select("text", "n_chars").first()
    assert text == f'é api_key = "{secrets_crf.MASK}" ok' and size == len(text)
    assert secrets_crf.find_secrets(docs).where("doc_id <= 3").collect() == [] and secrets_crf.find_secrets(none).collect() == []
    assert secrets_crf.redact(docs).where("doc_id <= 3").select("text").collect() == docs.where("doc_id <= 3").select("text").collect()


def test_secrets_are_those_of_whole_chains(spark, docs):
    """Each document's tokens tagged by one Viterbi over the whole of it, without cutting chains."""
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 3000 AND (doc_id < 100 OR text LIKE '%token%')").union(docs.select(F.col("doc_id") + 10**6, "text").where("length(text) < 3000"))
    model, want = secrets_crf.fit(), set()
    for i, t in ((r.doc_id, r.text or "") for r in d.collect() if r.doc_id is not None):
        raw = t.encode()
        buf, offs = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
        s, e, doc, *rest = secrets_crf.observe(buf, offs)
        if not len(s):
            continue
        tags = secrets_crf.viterbi(secrets_crf.emissions(model, doc, *rest).astype(np.float64), model.trans.astype(np.float64))
        k = 0
        while k < len(tags):
            j = k + 1
            if tags[k] != 0:
                while j < len(tags) and tags[j] == 2:
                    j += 1
                a, b = len(raw[: s[k]].decode()), len(raw[: e[j - 1]].decode())
                want.add((i, a, b, t[a:b]))
            k = j
    assert {tuple(r) for r in secrets_crf.find_secrets(d).collect()} == want and want


def test_warc(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = warc.captures(warc.records(warc.render(pages))).collect()
    want = {(r.page_id, r.url): r.html or "" for r in pages.collect()}
    assert len(got) == len(want)
    for r in got:
        (fields,) = r.metadata
        (request,) = r.request
        page = int(re.search(r"page_id: (\d+)", fields.fields)[1])
        html = want[page, r.target_uri].encode()
        assert bytes(r.response.body) == html and f"bytes: {len(html)}" in fields.fields and r.response.status == 200 and r.response.content_type == "text/html; charset=utf-8"
        host, _, path = r.target_uri.partition("://")[2].partition("/")
        assert request.head == f"GET /{path} HTTP/1.1\r\nHost: {host}" and bytes(request.body) == b"" and r.date == "2024-01-01T00:00:00Z" == request.date
    odd = spark.createDataFrame([(1, "http://a/b", None, 0), (None, "http://x", "y", 0), (2, None, "z", 0), (3, "http://a/c", "", 0)], "page_id long, url string, html string, record_id int")
    assert sorted(r.target_uri for r in warc.captures(warc.records(warc.render(odd))).collect()) == ["http://a/b", "http://a/c"]
    empty = warc.records(spark.createDataFrame([(None,), (b"",)], "warc binary"))
    assert empty.collect() == [] and warc.captures(empty).collect() == []


def brute_captures(records):
    """Transactions by following links one by one; records: (id, type, concurrent ids, content)."""
    least, names = {}, {}
    for i, kind, to, content in records:
        least[i] = min(least.get(i, (kind, content)), (kind, content))
        for x in to:
            if x != i:
                names.setdefault(i, set()).add(x)
                names.setdefault(x, set()).add(i)
    out = {}
    for i, (kind, _) in least.items():
        if kind == "response":
            seen, todo = set(), [i]
            while todo:
                for x in names.get(todo.pop(), ()):
                    if x in least and x not in seen and least[x][0] != "response":
                        seen.add(x)
                        todo.append(x)
            out[i] = {k: sorted((x, least[x][1]) for x in seen if least[x][0] == k) for k in ("request", "metadata")}
    return out


def test_warc_transactions_of_any_shape(spark):
    rng = np.random.default_rng(3)
    ids = [f"r{k}" for k in range(60)]
    records = [(i, str(rng.choice(["request", "response", "metadata", "metadata"])), [str(x) for x in rng.choice([*ids, "absent"], int(rng.integers(0, 3)))], f"{i} body") for i in ids]
    records += [(*records[5][:3], "another"), records[7]]
    raw = b"".join(warc._record(kind, i, "http://x", "text/plain", content.encode(), to, "d") for i, kind, to, content in records)
    got = {r.capture_id: {"request": [(x.record_id, bytes(x.body).decode()) for x in r.request], "metadata": [(x.record_id, x.fields) for x in r.metadata]} for r in warc.captures(warc.records(spark.createDataFrame([(raw, 1)], "warc binary, record_id int"))).collect()}
    assert got == brute_captures(records)


def test_warc_files(spark, tmp_path):
    """Compressed by record, whole or not at all; bodies that are no text; and what is broken is told, while the rest is read."""
    import gzip

    body = bytes(range(256))
    record = lambda k, content=body, **x: warc._record(x.get("kind", "response"), f"id{k}", "http://x", "image/png", content, [], "d")
    good = [record(k) for k in range(3)]
    (tmp_path / "sub").mkdir()
    for name, data in {"a.warc": b"".join(good), "sub/b.warc.gz": gzip.compress(b"".join(good)), "c.warc.gz": b"".join(map(gzip.compress, good)), "empty.warc": b""}.items():
        (tmp_path / name).write_bytes(data)
    rows = warc.read(spark, str(tmp_path)).collect()
    assert sorted(r.record_id for r in rows) == sorted([f"id{k}" for k in range(3)] * 3) and all(bytes(r.body) == body and r.skipped is None for r in rows)

    def ids(data):
        rows = warc.records(spark.createDataFrame([(data,)], "warc binary")).collect()
        assert all((r.type == warc.MALFORMED) == (r.record_id is None) == (r.skipped is not None) for r in rows)
        return [r.record_id for r in rows]

    bad = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <bad>\r\nContent-Length: abc\r\n\r\ncontent\r\n\r\n"
    long = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <bad>\r\nContent-Length: 99999\r\n\r\ncontent\r\n\r\n"
    assert ids(good[0] + bad + good[1]) == ["id0", None, "id1"]
    assert ids(good[0] + long + good[1]) == ["id0", None, "id1"]
    assert ids(b"no warc\n" + good[0]) == [None, "id0"] and ids(b"no warc") == [None]
    assert ids(good[0] + b"WARC/1.1\r\nWARC-Type: x\r\n" + good[1]) == ["id0", None, "id1"]
    assert ids(good[0] + good[1][:-40]) == ["id0", None]
    assert ids(good[0] + warc._record("response", "", "u", "t", b"x", [], "d") + good[1]) == ["id0", None, "id1"]
    zipped = [gzip.compress(x) for x in good]
    assert ids(zipped[0] + zipped[1][:-9]) == ["id0", "id1"] or None in ids(zipped[0] + zipped[1][:-9])
    assert ids(zipped[0] + zipped[1][: len(zipped[1]) // 2] + zipped[2])[-1:] == ["id2"]


def odd_texts(spark, docs):
    odd = [(-1, "日本語 🎉 \u0007 mixed x" + "y" * 300), (-2, "a▁b  c"), (-3, " "), (-4, "-" * 500 + " qq" + "ab" * 100)]
    return docs.select(F.col("doc_id") + 10**6, "text").union(spark.createDataFrame(odd, "doc_id long, text string"))


@pytest.mark.parametrize("table_bytes", [sentencepiece_lattice.TABLE_BYTES, 30_000, 0])
def test_sentencepiece_is_the_encoder_of_the_model(spark, docs, none, table_bytes):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_lattice.MODEL)
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").toDF("doc_id", "text").union(odd_texts(spark, docs).toDF("doc_id", "text"))
    texts = {r.doc_id: r.text or "" for r in d.collect()}
    rows = sentencepiece_lattice.encode_checked(d, table_bytes=table_bytes).collect()
    assert len(rows) == d.where("doc_id IS NOT NULL").count()
    for r in rows:
        assert r.ids == sp.encode(texts[r.doc_id]), texts[r.doc_id][:80]
        assert r.same and r.n_chars == len(texts[r.doc_id])
    assert sentencepiece_lattice.encode(none, table_bytes=table_bytes).collect() == []


def test_decoding_gives_the_texts_back(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_lattice.MODEL)
    d = odd_texts(spark, docs).toDF("doc_id", "text")
    texts = {r.doc_id: (r.text or "").replace("▁", " ") for r in d.collect()}
    assert {r.doc_id: r.text for r in sentencepiece_lattice.decode(sentencepiece_lattice.encode(d)).collect()} == {i: t for i, t in texts.items() if i is not None}
    ids = [None, [], [None, 1, 2, 10**9, -5], [259 + 3, None, 300], sp.encode("two words"), [3 + 0xE6, 3 + 0x97]]
    got = [r.text for r in sentencepiece_lattice.decode(spark.createDataFrame([(k, x, 0) for k, x in enumerate(ids)], "doc_id long, ids array<int>, text int")).orderBy("doc_id").collect()]
    assert got[:3] == ["", "", ""] and got[4] == "two words" and "\ufffd" in got[5] and got[3] == sp.decode([259 + 3, 300])


def cheapest(unit, cost, unknown):
    """The least cost over all ways to cut a unit."""
    ways = [[unit[a:b] for a, b in itertools.pairwise((0, *cuts, len(unit)))] for k in range(len(unit)) for cuts in itertools.combinations(range(1, len(unit)), k)]
    return min(sum(cost.get(p, unknown if len(p) == 1 else math.inf) for p in way) for way in ways)


def test_viterbi_fold(spark, tmp_path):
    """The fold finds the cheapest of all ways to cut a unit; words have the ids that the public unigram encoder gives them."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    rng = np.random.default_rng(5)
    pieces = {"".join(rng.choice(list("abc"), int(rng.integers(1, 5)))): float(rng.integers(1, 9)) for _ in range(25)}
    pieces.pop("c", None)
    table = spark.createDataFrame([(p, k, k, c) for k, (p, c) in enumerate(pieces.items())], "piece string, id int, rank long, cost double")
    units = sorted({"".join(rng.choice(list("abc"), int(rng.integers(1, 10)))) for _ in range(60)})
    found = sentencepiece_lattice.lattice(spark.createDataFrame([(k, u, 1) for k, u in enumerate(units)], "h long, unit string, n long"), table, 4, False)
    for unit, places in sentencepiece_lattice.viterbi_fold(found, 30.0).select("unit", "places").collect():
        cuts = [k for k in range(len(unit) + 1) if places >> k & 1]
        cost = sum(pieces.get(unit[a:b], 30.0 if b == a + 1 else math.inf) for a, b in itertools.pairwise(cuts))
        assert cost == cheapest(unit, pieces, 30.0)

    model = sentencepiece_model_pb2.ModelProto()
    with open(sentencepiece_lattice.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = sentencepiece_lattice.UNIGRAM
    for p in model.pieces:  # the encoder counts in single precision
        p.score = max(p.score, -40_000.0)
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    words = sorted({w for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() for w in (r.text or "").split()})[:4000]
    d = spark.createDataFrame(list(enumerate([*words, "日本🎉", "z" * 80])), "doc_id long, text string")
    for r in sentencepiece_lattice.encode(d, path).collect():
        assert r.ids == sp.encode([*words, "日本🎉", "z" * 80][r.doc_id])
    some = {r.doc_id: r.ids for r in sentencepiece_lattice.encode(d, path, lattice_chars=3).collect()}  # by the other way
    assert some == {k: sp.encode(w) for k, w in enumerate([*words, "日本🎉", "z" * 80])}

    model.normalizer_spec.remove_extra_whitespaces = True
    with open(path + "2", "wb") as f:
        f.write(model.SerializeToString())
    with pytest.raises(ValueError, match="keep texts"):
        sentencepiece_lattice.load(path + "2")


def test_toxicity_held_out(spark, docs, none):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.toxicity(d, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1").select("doc_id", F.col("toxic").alias("y")), "doc_id").toPandas()
    assert ((got.y == 1) == got.toxic).mean() > 0.95 and got[got.y == 1].toxic.mean() > 0.8  # some texts labelled toxic have no word of the kind
    assert got[got.y == 1].severity.mean() > got[got.y == 0].severity.mean() + 0.5
    assert toxicity.toxicity(none, labels).collect() == [] and not any(r.toxic for r in toxicity.toxicity(docs, labels.limit(0)).collect())
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == docs.count()
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, toxic int")
    assert len(toxicity.toxicity(docs, odd).collect()) == len(TEXTS) + 1


def test_toxicity_is_the_plain_sum(spark, docs):
    """Severity and probability of each text by counting its words' features one by one."""
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(*toxicity.sample(d, labels))
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    hashed = lambda raw: int(_text.span_hash(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0])
    mask, some = (1 << toxicity.BITS) - 1, d.where("doc_id < 60").union(docs.where("doc_id <> 17").select(F.col("doc_id") + 10**6, "text"))
    got = {r.doc_id: r for r in some.mapInArrow(toxicity._score(model), "doc_id long, severity double, p_toxic double, toxic boolean").collect()}
    for i, t in ((r.doc_id, r.text or "") for r in some.collect()):
        counts = {}
        for w in words(t):
            raw = w.encode()
            own = {hashed(raw) & mask} | {int(_text.mix(np.array([hashed(raw[:k]) + k & (1 << 64) - 1], np.uint64))[0]) & mask for k in toxicity.BEGINNINGS if len(raw) > k}
            for x in own & weight.keys():
                counts[x] = counts.get(x, 0) + 1
        z = sum(weight[x] * math.log1p(min(n, model.cap)) for x, n in counts.items())
        p = [1 / (1 + math.exp(-max(-30, min(30, z - b)))) for b in model.bounds]
        assert got[i].severity == pytest.approx(sum(p)) and got[i].p_toxic == pytest.approx(p[0]) and got[i].toxic == (got[i].p_toxic >= toxicity.REJECT)
    assert model.bounds.tolist() == sorted(model.bounds.tolist()) and len(weight) <= toxicity.MOST


def test_toxicity_leaves_texts_with_the_executors(spark, tmp_path):
    """The model is that of the sampled texts as a whole; what the driver's Python takes doesn't grow with their length."""
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    twice = d.union(d.where("doc_id % 9 = 0")).union(d.where("doc_id % 7 = 0").withColumn("text", F.lit(None).cast("string")))
    for x in (d, twice.repartition(5)):
        here, there = toxicity.fit(*toxicity.sample(x, labels)), toxicity.train(x, labels)
        assert len(here.buckets) > 10 and here.buckets.tolist() == there.buckets.tolist()
        assert there.weights.tolist() == pytest.approx(here.weights.tolist(), abs=1e-6) and there.bounds.tolist() == pytest.approx(here.bounds.tolist(), abs=1e-6)
    long = d.withColumn("text", F.concat("text", F.lit(" "), F.repeat(F.sha2(F.col("doc_id").cast("string"), 256), 600)))
    long.write.parquet(f"{tmp_path}/long")
    most = []
    for x in (d, spark.read.parquet(f"{tmp_path}/long")):
        tracemalloc.start()
        toxicity.drop_toxic(x, labels)
        most.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    assert most[1] < most[0] + 5, most


def test_mixing(spark, docs, none):
    rng = np.random.default_rng(4)
    for _ in range(2000):
        lengths = {int(k): int(c) for k, c in zip(rng.integers(1, 13, 5), rng.integers(0, 5, 5))}
        budget = int(rng.integers(0, 60))
        sums = {0}
        for k, c in lengths.items():
            sums = {x + k * n for x in sums for n in range(c + 1)}
        fit = mixing.fit_budget(lengths, budget, reserve=int(rng.choice([2, 4096])))
        assert sum(k * n for k, n in fit.items()) == max(x for x in sums if x <= budget) and all(0 < n <= lengths[k] for k, n in fit.items())
    assert mixing.fit_budget({2: 10, 5: 1}, 7) == {2: 1, 5: 1}
    d = spark.read.parquet(f"{SF}/documents.parquet")
    every = {r.doc_id: (r.source or "", len(re.findall(r"[^ \t\n\f\r\x0b]+", r.text or ""))) for r in d.collect()}
    got = mixing.select(d, {"src0": 1.0, "src1": 3.0}, 2000).toPandas()
    assert got.tokens.sum() <= 2000 and got.doc_id.is_unique and set(got.source) <= {"src0", "src1"} and all(every[r.doc_id] == (r.source, r.tokens) for r in got.itertuples())
    for source, budget in (("src0", 500), ("src1", 1500)):
        lengths = [n for s, n in every.values() if s == source and 0 < n <= budget]
        reach = 1
        for n in lengths:
            reach |= (reach << n) & ((1 << budget + 1) - 1)
        assert got[got.source == source].tokens.sum() == reach.bit_length() - 1
    chosen = sorted(map(tuple, mixing.select(d, budget=20_000).collect()))
    assert chosen == sorted(map(tuple, mixing.select(d, budget=20_000, rows_each=1).collect()))  # cut by the hash as finely as can be
    odd = mixing.select(docs).collect()
    assert len({r.doc_id for r in odd}) == len(odd) and {r.source for r in odd} <= {"", "s"} and not {1, 2, 3} & {r.doc_id for r in odd}
    assert mixing.select(none).collect() == [] and mixing.mix(docs).columns == docs.columns


def test_mixing_of_skewed_sources(spark):
    """One hot source, some middling, one stray document: the stray one doesn't decide how much of the rest is kept."""
    rows = [(k, "hot", " ".join(["w"] * (1 + k % 50))) for k in range(2000)] + [(10_000 + k, f"mid{k % 4}", " ".join(["w"] * (1 + k % 30))) for k in range(400)] + [(20_000, None, "w w w")]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    tokens = {}
    for _, s, t in rows:
        tokens[s or ""] = tokens.get(s or "", 0) + len(t.split())
    low, high, goal = 0.0, 1e9, int(sum(tokens.values()) * mixing.SHARE)
    for _ in range(200):  # the level at which sources, each cut off at what it has, fill the budget
        level = (low + high) / 2
        low, high = (level, high) if sum(min(n, level * n**mixing.ALPHA) for n in tokens.values()) <= goal else (low, level)
    want = {s: min(n, low * n**mixing.ALPHA) for s, n in tokens.items()}
    got = mixing.select(d).toPandas()
    chosen = got.groupby("source").tokens.sum().to_dict()
    assert set(chosen) == set(tokens) and all(want[s] - 50 <= n <= want[s] + 1e-6 for s, n in chosen.items())
    assert chosen[""] == 3 and chosen["hot"] > 0.8 * tokens["hot"] and sum(chosen.values()) > 0.89 * sum(tokens.values())
    assert {r.source: r.kept for r in got.itertuples()} == pytest.approx({s: n / tokens[s] for s, n in chosen.items()})
    assert mixing.targets({"a": 100, "b": 10, "c": 1}, {"a": 1.0, "b": 1.0, "c": 1.0}, 60) == {"a": 49, "b": 10, "c": 1}
    assert mixing.targets({"a": 100, "b": 10}, {"a": 1.0, "b": 9.0}, 10**6) == {"a": 100, "b": 10} and mixing.targets({}, None, None) == {}
    assert mixing.targets({"a": 100, "b": 100}, None, None) == {"a": 100, "b": 100}


def test_fingerprint(spark, docs, none):
    fold = lambda t: " ".join(unicodedata.normalize("NFC", unicodedata.normalize("NFC", t or "").casefold()).split())
    more = ["café  Bar", "cafe\u0301 bar\n", "STRASSE", "straße", "Straẞe", "ﬁne", "FINE", "ΣΊΣΥΦΟΣ", "σίσυφος"]
    rows = [(k + 1, t) for k, t in enumerate([*TEXTS, *more])]
    groups = {}
    for i, t in rows:
        groups.setdefault(fold(t), []).append(i)
    want = {(i, min(g), len(g)) for g in groups.values() for i in g}
    d = docs.select("doc_id", "text", "h").union(spark.createDataFrame([(i, t, 0) for i, t in rows[-len(more) :]], "doc_id long, text string, h int"))
    assert {tuple(r) for r in fingerprint.exact_copies(d).collect()} == want
    assert {tuple(r) for r in fingerprint.exact_copies(d, broadcast_bytes=0).collect()} == want
    assert fingerprint.exact_copies(none).collect() == []
    assert groups[fold("straße")] == [len(TEXTS) + k for k in (3, 4, 5)] and len(groups[fold("fine")]) == len(groups[fold("σίσυφος")]) == 2

    def digest(batches):  # of three values only, so that different texts share them
        for b in batches:
            n = [len(x.as_py() or "") % 3 for x in fingerprint.canonical(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array([0] * len(n), pa.int64())], names=["doc_id", "high", "low"])

    def texts(wanted):
        def run(batches):
            for b in batches:
                t = fingerprint.canonical(b.column(1))
                n = [len(x.as_py() or "") % 3 for x in t]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array([0] * len(n), pa.int64()), t], names=["doc_id", "high", "low", "text"])

        return run

    for limit in (fingerprint.BROADCAST_BYTES, 0):
        assert {tuple(r) for r in fingerprint._grouped(d, digest, texts, limit).collect()} == want


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    step = {r.doc_id: r.text for r in toxicity.drop_toxic(docs, labels).collect()}
    sets, kept = {i: grams(t) for i, t in step.items()}, set(step)
    parent = {i: i for i in step}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i, j in itertools.combinations(sorted(step), 2):
        if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 2 >= max(len(sets[i]), len(sets[j])) and 2 * len(sets[i] & sets[j]) >= len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    kept = {i for i in step if root(i) == i}
    left = docs.where(F.col("doc_id").isin(list(kept)))
    chosen = {r.doc_id for r in mixing.select(secrets_crf.redact(left)).collect()}
    assert {r.doc_id for r in rows} == chosen and rows and all(r.ids for r in rows)
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and math.isfinite(len(rows))


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nulls in any column, empty texts, ties, repeated rows, a further column, and no rows at all."""
    rows = [(1, None, None, None, None, 1), (None, "words of none", "en", "s", 3, 2), (2, "", "en", "s", 0, 3), (3, "same words in both", "en", None, 1, 4), (4, "same words in both", None, "s", 1, 5), (4, "same words in both", None, "s", 1, 5), (5, "other words " * 3000, "en", "t", 2, 6)]  # the last is more than its source's budget
    kind = "doc_id long, text string, lang string, source string, n_chars long, ids int"
    labels = spark.createDataFrame([(1, None, None), (2, 1, 1)], "doc_id long, quality int, toxic int")
    for name, part in (("some", rows), ("none", [])):
        spark.createDataFrame(part, kind).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/some/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{tmp_path}/some")
        assert docs.columns == kind.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    got = sorted((r.doc_id, r.n_chars, r.same) for r in corpus_pipeline.run(spark, f"{tmp_path}/some").collect())
    assert got == [(3, 18, True)] and corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if n.startswith("op")))
def test_sql(spark, name):
    """The registered query has the rows of its SQL, over whole tables."""
    import duckdb

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    found = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    df = __spark_entry__.queries()[name](spark, sf)
    plain = lambda rows: sorted(str([f"{v:.9g}" if isinstance(v, float) else v for v in r]) for r in rows)
    assert sorted(df.columns) == sorted(columns) and plain(df.select(*columns).collect()) == plain(found.fetchall())


def test_registered():
    assert {f"op{k}" for k in range(1, 11)} <= {n.partition("_")[0] for n in __spark_entry__.queries()} and "pipeline" in __spark_entry__.queries()
