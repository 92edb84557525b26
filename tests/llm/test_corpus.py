"""Mixing, packing, secrets, pages, archives, quality, neighbours and the pipeline against plain versions."""

import gzip
import hashlib
import random
import re
import string
import struct
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from cases import DOCS, LONG, docs, empty
from pyspark.sql import functions as F
from skirmish.llm import main_text, mixing, neighbours, packing, quality, secret_scan, simhash, warc
from skirmish.llm.queries import QUERIES
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def slow_targets(sizes):
    """Re-share the excess until none is above; sources in order."""
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    goal, full, target = 1.5 * sum(sizes.values()), set(), {}
    while True:
        rest = [s for s in sizes if s not in full]
        left = goal - sum(2 * sizes[s] for s in full)
        target = {s: 2.0 * sizes[s] for s in full} | {s: left * weights[s] / sum(weights[r] for r in rest) for s in rest}
        over = {s for s in rest if target[s] > 2 * sizes[s] or sizes[s] == 0}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("seed", range(4))
def test_mix(spark, seed):
    rng = random.Random(seed)
    rows = list(DOCS) + [(100 + i, "w " * rng.randrange(60), rng.choice([None, "a", "B", "b", "Z", "é", "zz"])) for i in range(400)]
    sized = mixing.sized(docs(spark, rows))
    got = mixing.mix(sized, mixing.targets(mixing.cycled_weights(sized))).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r["size"] * r.times
        assert 0 <= r.times <= 2
    target = slow_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
    for s in sizes:
        largest = max(r["size"] for r in got if r.source == s)
        assert abs(taken[s] - target[s]) <= 2 * largest  # full repeats of a row are drawn together
    again = mixing.mix(sized, mixing.targets(mixing.cycled_weights(sized))).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    mixed = mixing.mixed_documents(docs(spark, rows))
    assert mixed.columns == docs(spark).columns and mixed.count() == sum(r.times for r in got)


def test_mix_of_nothing(spark):
    assert mixing.mixed_documents(empty(spark)).count() == 0
    assert mixing.mixed_documents(docs(spark, [(1, "", "a"), (2, None, None)])).count() in range(5)


def test_decompose():
    for most in (1, 8, 2048):
        for n in range(1, 5000, 7):
            lengths = packing.decompose(n, most)
            assert sum(lengths) == n and lengths == sorted(lengths, reverse=True) and max(lengths) <= most
            assert all(x & (x - 1) == 0 for x in lengths)
            assert all(x != y or x == most for x, y in zip(lengths, lengths[1:]))


def test_pack(spark):
    rows = list(DOCS) + [(50, "It's 2024!  \n\n don't <|endoftext|> stop now…  ", "a"), (51, "é" * 50 + " 日本語テキスト 🙂🙂", "b")]
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    got = packing.pack(docs(spark, rows), PATH).collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 for r in got)
    whole = []
    for first in [i for i, r in enumerate(got) if r.start == 0]:
        ids, at = b"", 0
        while at < got[first].doc_tokens:
            piece = next(r for r in got[first:] if r.doc_id == got[first].doc_id and r.start == at)
            assert piece.length == len(piece.ids) // 4 and piece.length & (piece.length - 1) == 0 and piece.length <= 2048
            ids, at = ids + bytes(piece.ids), at + piece.length
        whole.append((got[first].doc_id, ids))
    want = []
    for i, v, _ in rows:
        ids = tokenizer.encode(v or "", add_special_tokens=False).ids + [1]
        want.append((i, struct.pack(f"<{len(ids)}I", *ids)))
    assert sorted(whole, key=repr) == sorted(want, key=repr)
    assert packing.pack(empty(spark), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs(spark), PATH, most=100)


def test_encoder_of_a_long_text_and_a_small_table():
    encoder, tokenizer = packing.Encoder(PATH, words=50, special=True), Tokenizer.from_file(PATH)
    text = " ".join(f"token{i % 70} and-more" for i in range(90_000))
    rng = random.Random(7)
    odd = ["".join(rng.choice("ab'slre  \n\t\x1c 019.,_\u00e9\u00f1\u00b2\u00aa\u2026\u2019\xa0 \u65e5\u0301<|>") for _ in range(rng.randrange(60))) for _ in range(3000)]
    for value in [text[:2000], text, " " * 200_000 + "x", "a<|endoftext|> " * 3, "", *odd]:
        ids = tokenizer.encode(value, add_special_tokens=False).ids
        assert encoder.encode(value) == encoder.encode_by_word(value) == struct.pack(f"<{len(ids)}I", *ids)


def test_op9_agrees_with_the_tokenizer(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tokenizer = Tokenizer.from_file(PATH)
    for r in QUERIES["op9_packing"](spark, SF).where("doc_id % 5 = 0").collect():
        ids = tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [1]
        part = ids[r.start:r.start + r.length]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))


KINDS = ((secret_scan.ASSIGN, 2, 8), ("AKIA[A-Z0-9]+", 0, 16), ("[0-9a-f]+", 0, 32))


def slow_base(value):
    found = sorted((m.start(), kind, m.end()) for kind, (pattern, group, least) in enumerate(KINDS)
                   for m in re.finditer(pattern, value or "") if len(m[group]) >= least)
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in found)


def test_secrets(spark):
    rng = random.Random(9)
    key = lambda n, chars: "".join(rng.choice(chars) for _ in range(n))
    many = " é ".join(f"token={key(9, string.hexdigits)} {key(33, '0123456789abcdef')}" for _ in range(700))
    rows = list(DOCS) + [
        (20, "token=secret:abcdefghij Password : 'hunter2hunter2' apikey=\"short\"", "a"), (21, "AKIAAKIA12345678901 AKIA123", "a"),
        (22, "é" * 10 + "deadbeef" * 4 + "g" + "deadbeef" * 3, "a"), (23, many, "a"), (24, "passwd" + "=" * 3 + "x" * 8, "b"),
        (25, "see " + key(32, string.ascii_letters + string.digits) + " here", "a"), (26, "an_ordinary_identifier_of_some_length here", "a"),
        (27, "1234567890-1234567890-1234567890", "a"), (28, "internationalisationofinternationalisation", "a")]
    rows += [(1000 + i, "an ordinary sentence about the identifiers of international organisations and some_length", "a") for i in range(40)]
    found = {}
    for r in secret_scan.find_secrets(docs(spark, rows)).select(
            "doc_id", secret_scan.listed(F.col("base")).alias("base"), secret_scan.listed(F.col("all")).alias("all")).collect():
        found.setdefault(r.doc_id, []).append((r.base, r["all"]))
    for i, v, _ in rows:
        assert slow_base(v) in [b for b, _ in found[i]], i
    for base, everything in (x for xs in found.values() for x in xs):
        assert set(base.split(",")) <= set(everything.split(",")) or not base
    assert found[25] == [("", "random:4:36")]
    assert found[26] == found[27] == found[28] == [("", "")]
    assert secret_scan.find_secrets(empty(spark)).count() == 0


def test_op10_against_python(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op10_secrets"](spark, SF).collect():
        base = slow_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [base.count(k + ":") for k in ("assign", "access", "hex")]


PROSE = "The cat of the house is in the garden with the dog and it is not at all amused by what they are up to. "


@pytest.mark.parametrize(("page", "want"), [
    ("", []), ("<p>a<b>b</b>c &amp;amp; d&nbsp;&eacute;<br>e</p>", ["abc &amp; d é e"]),
    ("<div class=cookie-notice>We use cookies</div><main><h1>T</h1><p>Body</p><section id='comments'><p>nice</p></section></main>", ["T", "Body"]),
    ("<article><header><h1>T</h1></header><p>x<p>y<script>var a='</p>'</script><form><input>f</form>z<!-- c > --></article", ["T", "x", "y", "z"]),
    (f"<header>Site</header><div><p>{PROSE * 3}</p><p>Short one.</p><p>{PROSE * 3}</p></div><ul><li><a href=x>link</a></ul><footer>(c)</footer>",
     [(PROSE * 3).strip(), "Short one.", (PROSE * 3).strip()]),
    (f"<div><p>Lost.</p></div><ul><li><a href=1>one two</a></li></ul><p>{PROSE * 3}</p>", [(PROSE * 3).strip()]),
    ("<article><p>one</p><aside>side</aside><ul><li class='ad'>buy</li><li>two</li></ul><nav><a>x</a></nav></article><p>after</p>", ["one", "two"]),
    ("<p hidden>no</p><p style='display: none'>no</p><p>yes", ["yes"]), ("<a href='x>y' title=\"a>b\">q</a>" * 3, []),
    ("<article><p>a &lt;b&gt; 1 < 2</p><title>no</title><p>&#x41;&#66;</p></article>", ["a <b> 1 < 2", "AB"]),
])
def test_main_text(page, want):
    assert main_text.main_blocks(page) == want


def test_main_text_of_hostile_pages():
    for page in ("<p " * 50_000, "<a '" * 50_000, "<!--" * 50_000, "<div>" * 20_000 + "x", "</div>" * 20_000, "&" * 100_000):
        main_text.main_blocks(page)


def test_extract(spark):
    rows = [(1, "u", "<article><p>Hé</p></article>", "x"), (1, "u", "<article><p>Hé</p></article>", "x"), (None, None, None, "y"), (2, "v", "", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, main_text.extract(pages).collect()), key=repr)
    assert got == sorted([(1, "u", "Hé", 2), (1, "u", "Hé", 2), (None, None, "", 0), (2, "v", "", 0)], key=repr)
    assert main_text.extract(pages.where("1 = 0")).count() == 0


def test_op7_gives_the_article(spark):
    import html

    texts = {r.page_id: r.text for r in QUERIES["op7_main_text"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = r.html.split("<article>", 1)[1].split("</article>")[0]
        parts = [" ".join(html.unescape(re.sub("</?b>|<br>", "", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert texts[r.page_id] == "\n".join(x for x in parts if x)


def archive_bytes(path):
    fs, root = warc.file_system(path)
    names = sorted(x.base_name for x in fs.get_file_info(warc.pafs.FileSelector(root)) if x.base_name.endswith(".gz"))
    return {n: fs.open_input_stream(f"{root}/{n}", compression=None).read() for n in names}


def test_archives(spark, tmp_path):
    body = "<p>" + "x" * 200 + "</p>"
    rows = [(5, "http://a/", body), (3, "http://b/\r\nEvil: 1", body), (9, None, body), (9, "http://c/", body), (1, "http://d/", "small"),
            (2, "http://e/", "small"), (4, "http://f/", None), (None, "http://g/", body), (7, "http://h/", "\r\n\r\né" * 60_000), (6, "http://i/", "")]
    rows += [(100 + i, f"http://n/{i}", "".join(random.Random(i).choices(string.printable, k=3000))) for i in range(60)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    paths = [f"{tmp_path}/{n}" for n in "ab"]
    manifests = [warc.write_archives(p, path, roll_bytes=8000).collect() for p, path in zip((pages, pages.repartition(3)), paths)]
    files = archive_bytes(paths[0])
    assert files == archive_bytes(paths[1])  # whatever the order of the rows
    assert {m.name: (m.bytes, m.sha256) for m in manifests[0]} == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in files.items()}
    assert sum(m.records for m in manifests[0]) == len(rows) and len(files) > 8
    for data in files.values():
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")
    got = warc.read_archives(spark, paths[0]).collect()
    want = []
    for page, url, value in rows:
        payload = (value or "").encode()
        revisit = value == body and page not in (3, None)
        url = url and url.replace("\r\n", "%0D%0A")
        want.append((page, url, "revisit" if revisit else "response", None if revisit else payload, len(payload),
                     hashlib.sha256(payload).hexdigest(), 3 if revisit else None))
    assert sorted(((r.page_id, r.url, r.record_type, None if r.payload is None else bytes(r.payload), r.payload_bytes,
                    r.payload_digest, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    ids = {r.page_id: r.record_id for r in got}
    assert len(set(ids.values())) == len(ids)
    warc.write_archives(pages.where("1 = 0"), f"{tmp_path}/none")
    assert warc.read_archives(spark, f"{tmp_path}/none").count() == 0


def test_damaged_records_are_refused():
    good = warc.record(1, "http://a/", b"payload", hashlib.sha256(b"payload").hexdigest(), None, False, "2000-01-01T00:00:00Z")
    assert warc.parse(good)["payload"] == b"payload"
    for bad in (good[:-1], good.replace(b"payload", b"paYload"), b"X" + good, good.replace(b"Length: 7", b"Length: 8")):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_quality_held_out(spark):
    got = {r.doc_id: r for r in QUERIES["op3_quality"](spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len(got) == 1000
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    pairs = [(got[i].score, q) for i, q in labels.items() if got[i].held_out]
    good, bad = [s for s, q in pairs if q == 1], [s for s, q in pairs if q == 0]
    area = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert area > 0.95 and np.mean([s >= 0.3 for s in good]) > 0.95


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 1), (7, 0), (9, None), (None, 1), (4, 1)], "doc_id long, quality int")
    for docs_, labels_ in ((docs(spark), labels), (docs(spark), labels.where("1 = 0")), (docs(spark).drop("n_chars"), labels), (empty(spark), labels)):
        model = quality.train(docs_, labels_)
        scores = [r[0] for r in docs_.select(quality.score(docs_, model)).collect()]
        assert len(scores) == docs_.count() and all(0 <= s <= 1 for s in scores)


def test_interactions_in_linear_time():
    rng = np.random.default_rng(0)
    model = quality.Model(np.zeros((1, 7)), 0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    x = rng.normal(size=(4, 6))
    pairs = [(i, j) for i in range(6) for j in range(i)]
    slow = [0.3 + r @ model.weights + sum(model.factors[i] @ model.factors[j] * r[i] * r[j] for i, j in pairs) for r in x]
    assert np.allclose(model.logits(x), slow)


def test_features_by_blocks(monkeypatch):
    whole = quality.features(LONG[:200_000].encode(), 5.0)
    from skirmish.llm import text
    monkeypatch.setattr(text.word_blocks, "__defaults__", (1000,))
    for a, b in zip(whole, quality.features(LONG[:200_000].encode(), 5.0)):
        assert np.allclose(a, b)


def cosines(x, q):
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


def test_nearest_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], np.float64), np.array([r.vec_id for r in rows])
    got = {}
    for r in QUERIES["op8_nearest"](spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r.query_id, []).append(r)
    hits = 0
    for q in ids[ids % 50 == 0]:
        scores = cosines(x, x[ids == q][0])
        scores[ids == q] = -2
        found = sorted(got[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == [1, 2, 3, 4, 5]
        for r in found:
            assert r.score == scores[ids == r.vec_id][0]
        hits += len({r.vec_id for r in found} & set(ids[np.lexsort((ids, -scores))[:5]].tolist()))
    assert hits >= 0.9 * 5 * len(got)


def test_nearest_of_odd_vectors(spark):
    rng = random.Random(4)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 300)] + [(1000 + i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(80)]
    rows += [(2000, None), (2001, []), (2002, [0.0, 0.0, 0.0]), (2003, [1.0, None, 1.0]), (2004, [1.0, float("nan"), 0.0]),
             (2005, [float("inf"), 0.0, 1.0]), (2006, [1.0, 2.0]), (None, [1.0, 2.0, 3.0]), (50, [1.0, 2.0, 3.0]), (2050, [2.0, 4.0, 6.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, rank string")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i, v in rows if i is not None and i % 50 == 0 and i not in (2000,)}
    same = [i for i in range(7)]
    for q in (0, 50, 250, 2050):
        assert [x[1] for x in sorted(got[q])] == [i for i in same if i != q][:5]
    usable = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows
              if i is not None and v and len(v) == 3 and None not in v and np.isfinite(v).all() and any(v)]
    for q, found in got.items():
        mine = next(v for i, v in usable if i == q)
        for _, i, s in found:
            assert s == cosines(next(v for j, v in usable if j == i)[None], mine)[0]
    assert neighbours.nearest(df.where("1 = 0"), F.col("vec_id") % 50 == 0).count() == 0
    one = neighbours.nearest(df.where("vec_id = 50"), F.col("vec_id") % 50 == 0)
    assert one.count() == 0


def test_pipeline(spark):
    """Stage by stage against plain Python, given the classifier's decisions."""
    docs_ = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality_filter(spark, docs_, SF)
    rows = {r.doc_id: r for r in kept.collect()}
    texts, best = {}, {}
    for i in sorted(rows):
        best[(rows[i].text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))] = i
    texts = {i: rows[i].text for i in best.values()}
    prints = {i: simhash.simhash((t or "").encode()) & (1 << 64) - 1 for i, t in texts.items()}
    group = {i: i for i in prints}
    for i in sorted(prints):
        for j in sorted(prints):
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 4 and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    left = [i for i in texts if group[i] == i]
    survivors = kept.where(F.col("doc_id").isin(left))
    sized = mixing.sized(survivors)
    times = {r.id: r.times for r in mixing.mix(sized, mixing.targets(mixing.cycled_weights(sized))).collect()}
    tokenizer, want = Tokenizer.from_file(PATH), []
    for i in left:
        ids = tokenizer.encode(texts[i] or "", add_special_tokens=False).ids + [1]
        start = 0
        for length in packing.decompose(len(ids), 2048):
            want += [(i, start, struct.pack(f"<{length}I", *ids[start:start + length]))] * times[i]
            start += length
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.start, bytes(r.ids)) for r in got) == sorted(want)
    assert len({r.sequence_id for r in got}) == len(got)


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_tables(spark, k):
    for frame in (docs(spark), empty(spark)):
        frame = frame.select("doc_id", "text", "lang", "source", "n_chars")
        out = corpus_pipeline.STAGES[k][1](spark, frame, SF)
        rows = out.count()
        assert rows == 0 if frame.isEmpty() else rows > 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == frame.columns
