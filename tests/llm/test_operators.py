"""Every registered query against a plain version on a small fixture with all awkward cases, and on empty tables."""

from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fiscal_ledger.llm import embeddings, near_duplicates, quality, repeats
from fiscal_ledger.llm.fingerprints import fingerprints
from fiscal_ledger.llm.html_text import main_text
from fiscal_ledger.llm.mixing import mixed
from fiscal_ledger.llm.queries import oracle_sql, queries
from fiscal_ledger.llm.token_counts import split_safely, token_counts
from tests.llm import brute, fixture

QUERIES = queries()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return fixture.write(spark, str(tmp_path_factory.mktemp("tables")))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return fixture.write(spark, str(tmp_path_factory.mktemp("empty")), empty=True)


def query(name):
    return next(of for key, of in QUERIES.items() if key.startswith(f"op{name}_"))


def canonical(rows):
    return sorted((tuple(row) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, folder, name):
    nothing = QUERIES[name](spark, empty)
    assert nothing.collect() == []
    assert nothing.columns == QUERIES[name](spark, folder).columns


def test_nothing_but_blanks(spark, tmp_path):
    """Documents and pages without any text, vectors without any value."""
    folder = str(tmp_path)
    spark.createDataFrame([(i, [None, "", " \n"][i % 3], None, None, 0) for i in range(6)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, None, [None, ""][i % 2]) for i in range(4)], "page_id bigint, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(i, None, None) for i in range(4)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    rows = {number: query(number)(spark, folder).collect() for number in range(1, 11)}
    assert all(len(rows[n]) == (4 if n in (2, 3, 9) else 6) for n in rows)
    assert all(r.taken == 0 and r.target == 0 for r in rows[10])
    assert not any(r.rejected for r in rows[8])
    assert {r.class_id for r in rows[6]} == {0, 2}  # null counts as empty; the blank text is another
    assert all(r.kept and r.n_links == 0 for r in rows[3])


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, folder, name):
    connection = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    found = QUERIES[name](spark, folder)
    columns = sorted(found.columns)
    expected = connection.sql(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})").fetchall()
    actual = found.select(*columns).collect()
    if name.startswith("op10"):  # rows that are the same share a fate here; SQL takes them one by one
        twice = {2, None}
        place = columns.index("doc_id")
        expected = [r for r in expected if r[place] not in twice]
        actual = [r for r in actual if r[place] not in twice]
        sources = {d[0]: d[3] for d in fixture.documents()}
        # The two documents of a source with a repeated row may shift its later ones.
        expected = [r for r in expected if sources[r[place]] in ("a", "b", "c")]
        actual = [r for r in actual if sources[r[place]] in ("a", "b", "c")]
    assert canonical(actual) == canonical(expected)


def edited_texts():
    docs = sorted(
        ((d[0], d[1] or "") for d in fixture.documents()),
        key=lambda d: (d[0] is None, -(d[0] or 0), brute.spark_xxhash64(d[1])),
    )
    for at, (doc_id, text) in enumerate(docs):
        after = docs[(at + 1) % len(docs)][1]
        yield doc_id, text, text[: len(text) - len(text) // 2] + after[: len(text) // 2], after


def test_fingerprints(spark, folder, monkeypatch):
    def printed(text):
        return "".join(f"{n & brute.U64:016x}" for n in brute.fingerprint(text))

    def likeness(one, other):
        a, b = set(brute.fingerprint(one)), set(brute.fingerprint(other))
        bins = {(n & brute.U64) >> 56 for n in a | b}
        return len(a & b) / len(bins) if bins else 1.0

    expected = canonical(
        (i, len(t), hashlib.sha256(e.encode()).hexdigest(), printed(t), printed(e), likeness(t, e), likeness(t, n))
        for i, t, e, n in edited_texts()
    )
    assert canonical(query(1)(spark, folder).collect()) == expected
    # The same when neighbours are dealt over several groups.
    monkeypatch.setattr("fiscal_ledger.llm.fingerprints.GROUP_ROWS", 5)
    assert canonical(query(1)(spark, folder).collect()) == expected


def test_fingerprints_follow_order(spark):
    a, b = " ".join(f"w{i}" for i in range(300)), " ".join(f"v{i}" for i in range(300))
    rows = fingerprints(spark.createDataFrame([(1, f"{a} {b}"), (2, f"{b} {a}"), (3, f"{a} {b} x")], "doc_id int, text string"))
    signs = {r.doc_id: set(r.signature) for r in rows.collect()}
    assert len(signs[1] & signs[3]) > len(signs[1] & signs[2])


@pytest.mark.parametrize("kinds", [256, 1])
def test_repeats(spark, folder, monkeypatch, kinds):
    monkeypatch.setattr(repeats, "MOST_KINDS", kinds)
    docs = [(d[0], (d[1] or "").encode()) for d in fixture.documents()]
    expected, texts = [], []
    for (doc_id, data), gone in zip(docs, brute.removed_bytes([t for _, t in docs]), strict=True):
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        expected.append((doc_id, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
        texts.append((doc_id, kept.decode("utf-8", "replace")))
    assert sum(e[2] for e in expected) > 3000
    found = query(4)(spark, folder)
    assert canonical(found.drop("text").collect()) == canonical(expected)
    assert canonical(found.select("doc_id", "text").collect()) == canonical(texts)


def test_run_length_index():
    rng = np.random.default_rng(3)
    for trial in range(60):
        length = int(rng.choice([3, 5, 9]))
        texts = [bytes(rng.integers(97, 99 + trial % 3, rng.integers(0, 40)).astype(np.uint8)) for _ in range(rng.integers(1, 9))]
        found = [np.zeros(len(t), bool) for t in texts]
        for number, _, begin, end in repeats.marked_spans([(k, 0, 0, t) for k, t in enumerate(texts)], length):
            found[number][begin:end] = True
        assert all((a == b).all() for a, b in zip(found, brute.removed_bytes(texts, length), strict=True))


def test_tokens(spark, folder):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = [(d[0], d[1] or "") for d in fixture.documents()]
    encoded = [library.encode(t, add_special_tokens=False).ids for _, t in docs]
    assert canonical(query(5)(spark, folder).collect()) == canonical(
        (i, len(t.encode()), len(ids), len(ids) > 512) for (i, t), ids in zip(docs, encoded, strict=True)
    )
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert canonical(query(7)(spark, folder).collect()) == canonical(
        (i, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))
        for (i, _), ids in zip(docs, encoded, strict=True)
    )


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_of_other_vocabularies(spark, folder, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        of = sentencepiece.SentencePieceProcessor(model_file=path).encode
    else:
        library = Tokenizer.from_file(path)
        of = lambda text: library.encode(text, add_special_tokens=False).ids
    rows = token_counts(spark.read.parquet(f"{folder}/documents.parquet"), path).collect()
    assert canonical((r.doc_id, r.n_tokens) for r in rows) == canonical((d[0], len(of(d[1] or ""))) for d in fixture.documents())


def test_safe_splits_add_up():
    text = next(d[1] for d in fixture.documents() if d[1] and len(d[1]) > 10_000) + "\n\n  It's 12 <|endoftext|> x" * 50
    pieces = split_safely(text, 100)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(pieces) > 50 and "".join(pieces) == text
    assert sum(len(library.encode(p).ids) for p in pieces) == len(library.encode(text).ids)
    assert split_safely("a" * 1000, 100) == ["a" * 1000]


def test_near_duplicates(spark, folder):
    docs = [(d[0], d[1]) for d in fixture.documents()]
    classes = brute.near_duplicate_classes(docs)
    rows = query(6)(spark, folder).collect()
    assert canonical((r.doc_id, r.class_id) for r in rows) == canonical(
        (doc_id, found) for (doc_id, _), found in zip(docs, classes, strict=True)
    )
    assert len(set(classes)) < len(docs) - 4


def edited(rng, words, share):
    """The words with a share of them changed, spread over the text."""
    words = list(words)
    for at in rng.choice(len(words), round(share * len(words)), replace=False):
        words[at] = f"x{rng.integers(1 << 40)}"
    return words


def text_classes(spark, texts):
    rows = [(i, " ".join(words)) for i, words in enumerate(texts)]
    found = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    return {r.doc_id: r.class_id for r in found}


def test_near_duplicates_of_one_original(spark):
    """Versions that are like the original but not like each other; most buckets have another leader."""
    rng = np.random.default_rng(9)
    original = [f"w{n}" for n in rng.integers(0, 5000, 300)]
    versions = [edited(rng, original, 0.12) for _ in range(60)]
    found = text_classes(spark, [original, *versions])
    assert sum(c == 0 for c in found.values()) >= 0.8 * len(found)


def test_near_duplicates_at_the_threshold(spark):
    """Pairs of edit similarity 0.82 and 0.85, and short texts, which are found for certain."""
    rng = np.random.default_rng(11)
    pairs = []
    for number in range(240):
        size = 300 if number < 100 else int(rng.integers(5, 46))
        one = [f"t{number}w{n}" for n in rng.integers(0, 5000, size)]
        share = (0.18, 0.15)[number % 2] if number < 100 else math.floor(0.2 * size + 1e-9) / size
        pairs += [one, edited(rng, one, share)]
    pairs += ["a b c d e f g h i".split(), "a b c d x f g h i".split(), "p q r s t".split(), "p q r t".split()]
    found = text_classes(spark, pairs)
    met = [found[i] == found[i + 1] for i in range(0, len(pairs), 2)]
    # Texts of up to SHORT words always meet, longer ones nearly always.
    assert all(same for same, text in zip(met, pairs[::2], strict=True) if len(text) <= 40)
    assert sum(met[:100]) >= 97


def test_signs_rule_out_only_texts_that_differ():
    rng = np.random.default_rng(10)
    for _ in range(300):
        one = [f"w{n}" for n in rng.integers(0, 30, rng.integers(1, 40))]
        other = edited(rng, one, rng.choice([0.1, 0.2, 0.4]))[: rng.integers(1, 41)]
        a, b = near_duplicates.signs(*near_duplicates.hash_words([" ".join(one), " ".join(other)]))
        near = brute.edit_distance(one, other) <= math.floor(0.2 * max(len(one), len(other)) + 1e-9)
        assert near_duplicates.may_be_alike([a], [b])[0] or not near


def test_edit_distance_in_band():
    rng = np.random.default_rng(8)
    for _ in range(500):
        one = rng.integers(0, 4, rng.integers(0, 14)).astype(np.uint32)
        other = np.delete(one, rng.integers(0, len(one))) if len(one) > 3 else rng.integers(0, 4, 5).astype(np.uint32)
        most = int(rng.integers(0, 8))
        exact = brute.edit_distance(list(one), list(other))
        assert near_duplicates.edit_distance_within(one, other, most) == (exact if exact <= most else None)


def test_quality(spark, folder):
    docs = [(d[0], d[1], d[2]) for d in fixture.documents()]
    labels: dict = {}
    for doc_id, good, toxic in fixture.labels():
        if doc_id is not None:
            old = labels.get(doc_id, (good, toxic))
            labels[doc_id] = (min(old[0], good) if good is not None else old[0], max(old[1] or 0, toxic or 0))
    expected = brute.quality(docs, labels)
    rows = query(8)(spark, folder).collect()
    assert len(rows) == len(docs)
    found = {}
    for row in rows:
        found.setdefault((row.doc_id, row.lang, row.chars), []).append(row)
    rejected = 0
    for (doc_id, text, lang), (perplexity, out) in zip(docs, expected, strict=True):
        row = found[doc_id, lang, len(text or "")][0]
        assert (row.perplexity is None) == (perplexity is None)
        assert perplexity is None or math.isclose(row.perplexity, perplexity, rel_tol=1e-9)
        assert row.rejected == out
        rejected += out
    assert rejected >= 4


def test_quality_keeps_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scored = quality.score_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"), keep=tuple(docs.columns))
    kept = scored.kept()
    assert kept.schema == docs.schema
    assert kept.count() == scored.decisions.where("NOT rejected").count()
    assert set(map(tuple, kept.collect())) <= set(map(tuple, docs.collect()))


def brute_vectors():
    rows = fixture.embeddings()
    vectors = [None if r[1] is None or None in r[1] or not r[1] else np.array(r[1], np.float32).astype(float) for r in rows]
    valid = [i for i, v in enumerate(vectors) if v is not None and np.isfinite(v).all() and v.any() and rows[i][2] is not None]
    links = []
    for i in valid:
        for j in valid:
            if j < i and rows[i][2] == rows[j][2] and len(vectors[i]) == len(vectors[j]):
                a, b = vectors[i] / np.abs(vectors[i]).max(), vectors[j] / np.abs(vectors[j]).max()
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.93:
                    links.append((i, j))
    return rows, links


def test_embeddings(spark, folder):
    rows, links = brute_vectors()
    found = brute.components(len(rows), links)
    least = {}
    for row, c in zip(rows, found, strict=True):
        least[c] = min(least.get(c, row[0]), row[0])
    degree = [sum(i in link for link in links) for i in range(len(rows))]
    assert max(degree) > embeddings.NEIGHBOURS
    expected = [(r[0], d, least[c], r[0] == least[c]) for r, d, c in zip(rows, degree, found, strict=True)]
    assert canonical(query(3)(spark, folder).collect()) == canonical(expected)


def turned(rng, vectors, cosine):
    """Vectors at a cosine from the given unit vectors."""
    aside = rng.standard_normal(vectors.shape)
    aside -= (aside * vectors).sum(axis=1, keepdims=True) * vectors
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    return cosine * vectors + math.sqrt(1 - cosine**2) * aside


def vector_table(spark, vectors):
    rows = [(i, vector.tolist(), 1) for i, vector in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def test_embeddings_link_tight_clumps(spark):
    """All places of every list go to the own clump; all links to the other one count."""
    rng = np.random.default_rng(4)
    middle = turned(rng, np.eye(64)[:1], 1.0)
    middles = np.concatenate((middle, turned(rng, middle, 0.965)))
    vectors = np.concatenate([turned(rng, np.repeat(m[None], 20, axis=0), 0.999) for m in middles])
    assert (vectors @ vectors.T).min() > 0.94
    rows = embeddings.near_duplicate_vectors(vector_table(spark, vectors))[0].collect()
    assert {(r.n_links, r.component_id) for r in rows} == {(39, 0)}


def test_embeddings_find_rare_pairs(spark, monkeypatch):
    """Pairs near the threshold among many vectors; the given nodes have no other links."""
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(5)
    lone = rng.standard_normal((4000, 64))
    lone /= np.linalg.norm(lone, axis=1, keepdims=True)
    vectors = np.concatenate((lone, turned(rng, lone[:200], 0.935)))
    rows = embeddings.near_duplicate_vectors(vector_table(spark, vectors))[0].collect()
    assert sum(r.n_links == 1 for r in rows) >= 2 * 0.98 * 200
    assert not any(r.n_links > 1 for r in rows)


def test_embeddings_audit_meets_links(spark, monkeypatch):
    """An audit asks on until it has linked nodes, and a result below the bound is an error."""
    monkeypatch.setattr(embeddings, "AUDITED", 50)
    rng = np.random.default_rng(6)
    lone = rng.standard_normal((300, 64))
    lone /= np.linalg.norm(lone, axis=1, keepdims=True)
    table = vector_table(spark, np.concatenate((lone, turned(rng, lone[:20], 0.96))))
    assert embeddings.near_duplicate_vectors(table)[1] == 1.0
    monkeypatch.setattr(embeddings, "_links_of", lambda chosen, nodes, threshold: {row.node: 9 for row in chosen})
    monkeypatch.setattr(embeddings, "MOST_SEARCHES", 1)
    with pytest.raises(RuntimeError, match="audited links"):
        embeddings.near_duplicate_vectors(table)


def test_embeddings_without_links_are_audited_by_probes(spark, monkeypatch):
    """Probes measure the blocks as they are, also those dealt on by hash, and change no result."""
    rng = np.random.default_rng(11)
    lone = rng.standard_normal((400, 48))
    lone /= np.linalg.norm(lone, axis=1, keepdims=True)
    table = vector_table(spark, lone)
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    rows, recall = embeddings.near_duplicate_vectors(table)
    assert embeddings.RECALL - embeddings.PROBE_ERROR <= recall <= 1
    assert {(r.n_links, r.component_id == r.vec_id, r.kept) for r in rows.collect()} == {(0, True, True)}
    monkeypatch.setattr(embeddings, "MOST_BLOCK", 4)
    monkeypatch.setattr(embeddings, "MOST_SEARCHES", 1)
    with pytest.raises(RuntimeError, match="audited links"):
        embeddings.near_duplicate_vectors(table)
    assert embeddings.near_duplicate_vectors(table.limit(0))[1] == 1.0


def test_mix_in_training_order(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = mixed(docs).collect()
    assert rows[0].__fields__ == docs.columns
    taken = brute.mix([(d[0], d[1], d[3]) for d in fixture.documents()])
    counts: dict = {}
    for doc, times in zip(fixture.documents(), taken, strict=True):
        if doc[0] is not None and doc[0] != 2 and doc[3] is not None:
            assert sum(r.doc_id == doc[0] for r in rows) == times
            counts[doc[3]] = counts.get(doc[3], 0) + times
    assert rows == mixed(docs).collect()


def test_positions_follow_the_schedule(spark):
    from pyspark.sql import functions as F

    from fiscal_ledger.llm.mixing import mix_plan

    sized = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("source"), F.lit(10).cast("bigint").alias("size"))
    plan = mix_plan(sized)
    rows = plan.select("source", F.explode("positions").alias("t")).collect()
    early = {s: sum(r.source == s and r.t < 0.5 for r in rows) / sum(r.source == s for r in rows) for s in "012"}
    assert early["0"] > 0.6 > 0.5 > early["2"]
    assert all(0 <= r.t <= 1 for r in rows)
    # All sources together are drawn at an even rate.
    assert abs(sum(r.t < 0.25 for r in rows) - len(rows) / 4) < 20


PAGE = (
    "<html><body class='has-sidebar'><header><h1>Site</h1></header><div id='menu'><a href=/>Home</a></div>"
    "<div class='content'><h2>Head</h2><p>First para, which is long, and has commas &amp; so on.<p>Second <i>one</i>.<br>line"
    "<ul><li>one thing<li>two things</ul></div><div id=comments><p>I think, that this, is a long comment, truly.</div>"
    "<script>if (a<b) {'</p>'}</script><form><p>Sign up, now, please, dear reader, of the page</p></form>"
    "<div class='cookie-notice'>We use cookies, ok?</div><aside>Aside, aside, aside</aside><footer>foot</footer>"
)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<p>unclosed <a href='x", "unclosed"),
        ("<", "<"),
        ("<!-- only --><script>x</script>", ""),
        (PAGE, "Head\nFirst para, which is long, and has commas & so on.\nSecond one. line\none thing\ntwo things"),
        ("<nav><ul><li><a>a</a></ul></nav><article><h1>T</h1><p>  x\n\ty &lt;b&gt; </p></article>", "T\nx y <b>"),
        ("<div class=ad>A long advert, with commas, and more commas, for you.</div><article><p>To.</article>", "To."),
        ("<article><p>Cut off &am", "Cut off &am"),
        ("<p>" + "word " * 30_000, ("word " * 30_000).strip()),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text
