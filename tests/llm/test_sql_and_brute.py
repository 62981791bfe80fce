"""The ten operators against SQL, brute force, the reference library, and awkward rows."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import ann, bpe, fixity, html_text, language_id, licences, media, mixing, near_dedup, quotations, queries, sql, words
from tallyforge.llm.queries import word_bpe

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
DOC = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 2


def awkward(spark):
    """Nulls everywhere, empty and long texts, repeated rows and ids, clashing names."""
    rng = random.Random(1)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60_000))
    rows = [(1, BASE + "a", "en", "s", 5), (1, BASE + "a", "en", "s", 5), (2, BASE + "b", None, None, None), (3, None, "en", "s", 0), (4, "", None, "t", 0), (None, BASE + "a", "en", "s", 3), (5, long, "en", "t", 9), (6, " \t\n", "en", "t", 9), (7, "Word", "en", "t", 9), (8, "word", "en", "t", 9), (9, "12 !?", "en", "t", 1), (1, "quite another text", "en", "s", 5)]
    df = spark.createDataFrame(rows, DOC).repartition(3)
    for name in ("id", "node", "set", "key", "a", "b", "copies", "parts", "cdf", "task"):
        df = df.withColumn(name, F.lit("clash"))
    return df, rows


def comparable(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in values)


def sql_rows(name, tables):
    con = duckdb.connect()
    for t, path in tables.items():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    found = con.execute(queries.oracle_sql().get(name, name))
    columns = [c[0] for c in found.description]
    return columns, comparable(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    df = queries.queries()[name](spark, SF)
    columns, want = sql_rows(name, {t: f"{SF}/{t}.parquet" for t in TABLES})
    assert sorted(columns) == sorted(df.columns) and want
    assert comparable(df.columns, [tuple(r) for r in df.collect()]) == want


# --- op1


def test_ann(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 16)) * 3
    x = [(i, [float(v) for v in np.float32(centres[i % 20] + rng.standard_normal(16))]) for i in range(3000)]
    x += [(3000 + i, x[100][1]) for i in range(50)]
    x += [(None, x[0][1]), (4000, None), (4100, [0.0] * 16), (4200, [float("nan")] * 16), (4300, [float("inf")] + [1.0] * 15), (4400, [None] * 16), (4500, [1.0]), (200, x[200][1])]
    df = spark.createDataFrame(x, "vec_id long, embedding array<float>").withColumn("part", F.lit(1)).withColumn("id", F.lit(1))
    got = defaultdict(list)
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    good = {i: np.array(v) for i, v in x[:3050] if v}
    assert set(got) == {i for i in good if i % 100 == 0}
    hits = 0
    for q, found in got.items():
        true = sorted((float(np.sqrt(np.square(v - good[q]).sum())), i) for i, v in good.items() if i != q)[:10]
        assert [r for r, _, _ in found] == list(range(1, 11)) and [s for _, _, s in found] == sorted(s for _, _, s in found)
        for _, v, s in found:
            assert s == pytest.approx(float(np.sqrt(np.square(good[v] - good[q]).sum())), rel=1e-12)
        hits += len({i for _, i in true} & {v for _, v, _ in found})
    assert hits >= 0.9 * 10 * len(got)
    ties = [(v, s) for _, v, s in got[100]]
    assert ties == [(3000 + i, 0.0) for i in range(10)]


def test_ann_small(spark):
    few = spark.createDataFrame([(100, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(few).orderBy("rank").collect()] == [(100, 1, 2), (100, 2, 1)]
    assert ann.search(few.filter("false")).count() == 0 == ann.search(few.filter("vec_id < 10")).count()


def test_ann_of_repeated_rows(spark):
    """Copies of rows change nothing, and an id of many vectors hides no other."""
    rng = np.random.default_rng(8)
    x = [(i, v) for i, v in enumerate(rng.standard_normal((600, 8)).tolist())]
    df = spark.createDataFrame(x, "vec_id long, embedding array<double>")
    four = df.unionByName(df).unionByName(df).unionByName(df)
    assert sorted(ann.search(four).collect()) == sorted(ann.search(df).collect())
    hot = [*x[:30], *((7, [c + 1e-3 * j for c in x[0][1]]) for j in range(25))]
    got = [(r["vec_id"], r["score"]) for r in ann.search(spark.createDataFrame(hot, df.schema)).orderBy("rank").collect()]
    near = {}
    for i, v in hot[1:]:
        near[i] = min(near.get(i, math.inf), float(np.sqrt(np.square(np.array(v) - x[0][1]).sum())))
    want = sorted((d, i) for i, d in near.items())[:10]
    assert [i for i, _ in got] == [i for _, i in want] and np.allclose([s for _, s in got], [d for d, _ in want])


def test_ann_of_large_tables(spark):
    """The number of parts that a table of millions of rows gets grows with it; more parts keep the recall."""
    sizes = [ann.parts_for(n) for n in (0, 10**6, 2**22 - 1, 2**22, 2**24, 2**26, 10**12, 10**14)]
    assert sizes == [32, 32, 32, 64, 128, 256, 16_384, 65_536]
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 16))[rng.integers(0, 200, 20_000)] + 0.4 * rng.standard_normal((20_000, 16))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(20_000), "embedding": pa.array(list(x))})).repartition(4)
    found = {}
    for r in ann.search(df, most_parts=64, sample_rows=16_384).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 20_000, 100):
        d = np.square(x - x[q]).sum(axis=1)
        d[q] = np.inf
        hits += len(found[q] & set(np.argpartition(d, 10)[:10].tolist()))
    assert len(found) == 200 and hits >= 0.9 * 2000


def test_ann_of_parts_within_parts(spark):
    """Two levels of routers keep the recall, the k nearest of small parts, and results that depend on no order of rows."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((200, 16))[rng.integers(0, 200, 20_000)] + 0.4 * rng.standard_normal((20_000, 16))
    x[:6_000] = x[0] + 1e-3 * rng.standard_normal((6_000, 16))  # a third of all rows about one point
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(20_000), "embedding": pa.array(list(x))}))
    runs = [ann.search(d, most_parts=64, router_parts=8).orderBy("query_id", "rank").collect() for d in (df.repartition(4), df.orderBy(F.desc("vec_id")))]
    assert runs[0] == runs[1] and [r["rank"] for r in runs[0]] == list(range(1, 11)) * 200
    found = {}
    for r in runs[0]:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert r["score"] == pytest.approx(float(np.sqrt(np.square(x[r["vec_id"]] - x[r["query_id"]]).sum())), rel=1e-12)
    hits = 0
    for q in range(0, 20_000, 100):
        d = np.square(x - x[q]).sum(axis=1)
        d[q] = np.inf
        hits += len(found[q] & set(np.argpartition(d, 10)[:10].tolist()))
    assert len(found) == 200 and hits >= 0.9 * 2000
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(400)], "vec_id long, embedding array<double>")
    for r in ann.search(same, most_parts=8, router_parts=2, rows_per_part=20).collect():
        others = [i for i in range(11) if i != r["query_id"]]
        assert r["score"] == 0.0 and r["vec_id"] == others[r["rank"] - 1]


def test_balanced_parts():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.standard_normal((128, 8)) + 9 * np.eye(8)[i % 8] for i in range(4)])
    part = ann.balanced_parts(ann.neighbour_graph(x, 5), 4, rng)
    assert np.bincount(part).tolist() == [128] * 4
    assert all(len(set(part[i * 128 : (i + 1) * 128])) == 1 for i in range(4))


# --- op2

CHAT = [
    (1, 0, "user", "Shall we meet?\n\nOn Monday  morning\nat nine."), (1, 1, "assistant", "> Shall we meet?\nYes."), (1, 2, "user", ">> shall   we MEET?\n> Yes.\n\n\nFine."),
    (1, 3, "assistant", "> On Monday morning at nine.\nToo early."), (1, 4, None, "Another matter."), (1, 5, "user", "> Too early.\r\n> not said by anyone\r\nLate then."),
    (1, 6, "user", "> Another matter.\nWhich?"), (1, 6, "user", "> Another matter.\nWhich?"), (2, 0, "user", None), (2, 1, "user", "> only a quote"), (None, 3, "user", "> x"), (2, None, "user", "> Yes."), (2, 2, "user", "")]


def test_quotations(spark, tmp_path):
    df = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string").repartition(2)
    df.coalesce(1).write.parquet(f"{tmp_path}/c")
    out = quotations.link_conversations(df.withColumn("lines", F.lit(1)).withColumn("position", F.lit(1)))
    rows = [tuple(r) for r in out.collect()]
    assert comparable(out.columns, rows) == sql_rows(sql.LINK_QUOTATIONS.replace("@MESSAGES@", "conversations"), {"conversations": f"{tmp_path}/c/*.parquet"})[1]
    by = {(r["conv_id"], r["turn"]): r for r in out.collect()}
    assert by[1, 1]["reply_to"] == 0 and by[1, 2]["reply_to"] == 1 and by[1, 2]["quote_levels"] == 2 and by[1, 3]["reply_to"] == 0 and by[1, 5]["reply_to"] == 3
    assert by[1, 2]["root_turn"] == 0 and by[1, 6]["root_turn"] == 4 and by[1, 2]["text"] == "Fine." and by[1, 2]["n_linked"] == 2
    assert by[1, 5]["text"] == "Late then." and by[2, 1]["text"] == ""
    order = [r["turn"] for r in out.filter("conv_id = 1").orderBy("position").collect()]
    assert order == [0, 1, 2, 3, 5, 4, 6, 6]
    assert quotations.link_conversations(df.filter("false")).count() == 0


def test_quotations_drill(spark, tmp_path):
    """Planted quotes, some of them nested, are linked to the turns they were taken from and stripped; also of a very long text."""
    rng = random.Random(2)
    rows = [(c, t, "user", f"line {c} {t}\n" + " ".join(rng.choice("abc") for _ in range(5)) * (200_000 if (c, t) == (3, 5) else 1)) for c in range(20) for t in range(30)]
    df = spark.createDataFrame([*rows, *rows[:2], (None, 1, "user", "x"), (7, None, "user", None), (8, 99, None, None)], "conv_id long, turn long, role string, text string").repartition(3)
    planted = quotations.drill(df.withColumn("__t", F.lit(1)).drop("__t"))
    out = {(r["conv_id"], r["turn"]): r for r in quotations.link_conversations(planted).collect()}
    nested = 0
    for c, t, _, text in rows:
        digit, r = hashlib.md5(f"{c}|{t}".encode()).hexdigest()[0], out[c, t]
        want = t - 1 if t and digit < "8" else None
        assert r["reply_to"] == want and r["text"] == (text.strip() if want is not None else text)
        assert r["n_linked"] == r["n_quoted"] == (t > 0 and digit < "8") + (t > 1 and digit < "4") and r["quote_levels"] == (2 if t > 1 and digit < "4" else int(want is not None))
        nested += t > 1 and digit < "4"
    assert nested > 100
    df.coalesce(1).write.parquet(f"{tmp_path}/c")
    out = quotations.link_conversations(planted)
    assert comparable(out.columns, [tuple(r) for r in out.collect()]) == sql_rows("op2_quotations", {"conversations": f"{tmp_path}/c/*.parquet"})[1]


def test_quotations_run_no_python(spark):
    df = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string")
    plan = quotations.link_conversations(quotations.drill(df))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- op3


def test_media_formats():
    rng = np.random.default_rng(2)
    for h, w in ((1, 1), (7, 5), (300, 24), (9, 301)):
        g, c = rng.integers(0, 256, (h, w), np.uint8), rng.integers(0, 256, (h, w, 3), np.uint8)
        assert (media.decode(media.encode_pgm(g)) == g).all() and (media.decode(media.encode_bmp(g)) == g).all()
        assert (media.decode(media.encode_ppm(c)) == c).all() and (media.decode(media.encode_bmp(c)) == c).all()
    assert media.decode(b"P2\n# note\n2 1 255\n7 9\n").tolist() == [[7, 9]]
    assert media.decode(b"P1 2 2\n10 01").tolist() == [[0, 255], [255, 0]] == media.decode(b"P4 2 2\n\x80\x40").tolist()
    assert media.decode(b"P5 1 1 65535\n\x01\x02").tolist() == [[258]]
    for bad in (b"", b"P5 4 4 255\nxx", b"BM", b"hello", b"P6 0 1 255\n"):
        with pytest.raises(media.MediaError):
            media.decode(bad)


def test_area_resize():
    x = np.random.default_rng(4).random((10, 7))
    big = x.repeat(6, axis=0).repeat(4, axis=1)  # 60 x 28
    assert np.allclose(media.area_resize(x, 6, 4), big.reshape(6, 10, 4, 7).mean(axis=(1, 3)))
    assert media.difference_hash(np.tile(np.arange(90), (20, 1))) == "f" * 16 and media.difference_hash(np.ones((3, 3))) == "0" * 16


def test_text_media(spark):
    df, rows = awkward(spark)
    got = sorted(map(tuple, media.text_media(df).collect()), key=str)
    want = []
    for i, text, *_ in rows:
        data = (text or "").encode()
        payload = data + b"\xff" * (max(1, math.ceil(len(data) / 576)) * 576 - len(data))
        stored = media.store(payload)
        want.append((i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest()))
    assert [r[:7] for r in got] == sorted(want, key=str)
    assert media.text_media(df.filter("false")).count() == 0


def test_media_tiles(spark):
    x = np.arange(300 * 24, dtype=np.uint32).astype(np.uint8).reshape(300, 24)
    df = spark.createDataFrame([(1, bytearray(media.encode_pgm(x))), (2, bytearray(b"no")), (None, None)], "image_id long, data binary")
    rows = media.media_tiles(df).collect()
    assert len(rows) == 4 and sum(r["error"] is not None for r in rows) == 2
    tile = next(r for r in rows if r["image_id"] == 1 and r["tile_row"] == 1)
    import io

    assert (np.load(io.BytesIO(tile["npy"])) == x[256:]).all()


# --- op4


def test_kneser_ney():
    """Against the textbook's formula, written with dictionaries."""
    text = " abracadabra abra cad"
    line = "\0\0" + text
    four = defaultdict(int)
    for i in range(3, len(line)):
        four[line[i - 3 : i + 1]] += 1
    counts = [None] * 5
    counts[4] = dict(four)
    for n in (3, 2, 1):
        counts[n] = defaultdict(int)
        for g in counts[n + 1]:
            counts[n][g[1:]] += 1
    chars = len(counts[1])

    def p(gram):
        if not gram:
            return 1 / (chars + 1)
        c = counts[len(gram)]
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        same = [v for g, v in c.items() if g[:-1] == gram[:-1]]
        if not same:
            return p(gram[1:])
        return max(c.get(gram, 0) - d, 0) / sum(same) + d * len(same) / sum(same) * p(gram[1:])

    pack = lambda g: sum(ord(ch) << 16 * (len(g) - 1 - i) for i, ch in enumerate(g))
    keys, n = np.array([pack(g) for g in four], np.uint64), np.array(list(four.values()))
    order = np.argsort(keys)
    model = language_id.KneserNey.fit(keys[order], n[order], chars)
    asked = [*four, "zzzz", "abrz", "zabr", "\0\0 z", "dabr"]
    got = model.log_p(np.array([pack(g) for g in asked], np.uint64), 4)
    assert np.allclose(got, [math.log(p(g)) for g in asked])
    found, sizes = language_id.grams(["Abra-CADABRA 1", "", "12"])
    assert sizes.tolist() == [len("abra cadabra "), 0, 0] and len(found) == sizes.sum()
    assert sum(math.exp(model.log_p(np.array([pack("abr" + c)], np.uint64), 4)[0]) for c in [*{g[-1] for g in four}]) < 1.0000001


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.identify_held_out(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (out["lang"] == out["lang_pred"])[out["held_out"]].mean() > 0.97
    assert out["held_out"].tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out["doc_id"]]
    assert not out["rejected"].mean() > 0.005 and out["score"].between(0, 1).all()
    model = language_id.fit(docs)
    odd = spark.createDataFrame([(1, "zqxj kvwq pzzk xqjv " * 30), (2, "Щит и меч " * 30), (3, None), (4, "12 34"), (5, docs.first()["text"])], "doc_id long, text string")
    found = {r["doc_id"]: r for r in language_id.identify(odd, model).collect()}
    assert [found[i]["rejected"] for i in range(1, 6)] == [True, True, True, True, False]
    assert found[3]["lang_pred"] == found[4]["lang_pred"] == "und" and found[3]["score"] == 0


def brute_languages(labelled, asked):
    """Predictions and scores by dictionaries: the textbook's formula for each language, on normalised texts."""
    def lines(text):
        low = "".join(c if c.isalpha() else " " for c in text.lower())
        own = re.sub(" +", " ", low).removeprefix(" ")
        return "\0\0 " + own if own.strip() else ""

    models, chars = {}, set()
    for lang in sorted({x for _, x in labelled}):
        four = Counter()
        for text, x in labelled:
            line = lines(text)
            if x == lang:
                four.update(line[i - 3 : i + 1] for i in range(3, len(line)))
        counts = {4: four}
        for n in (3, 2, 1):
            counts[n] = Counter(g[1:] for g in counts[n + 1])
        chars |= set(counts[1])
        models[lang] = counts
    out = []
    follow = {lang: {n: defaultdict(list) for n in c} for lang, c in models.items()}
    discount = {}
    for lang, c in models.items():
        for n, of in c.items():
            ones, twos = (sum(v == k for v in of.values()) for k in (1, 2))
            discount[lang, n] = ones / (ones + 2 * twos) if ones and twos else 0.5
            for g, v in of.items():
                follow[lang][n][g[:-1]].append(v)

    def p(lang, gram):
        n = len(gram)
        if not n:
            return 1 / (len(chars) + 1)
        same = follow[lang][n].get(gram[:-1])
        if not same:
            return p(lang, gram[1:])
        d = discount[lang, n]
        return max(models[lang][n].get(gram, 0) - d, 0) / sum(same) + d * len(same) / sum(same) * p(lang, gram[1:])

    for text in asked:
        line = lines(text or "")
        size = len(line) - 3
        if size <= 0:
            out.append(("und", 0.0, None))
            continue
        mean = {lang: -sum(math.log(p(lang, line[i - 3 : i + 1])) for i in range(3, len(line))) / size for lang in models}
        best = min(mean, key=lambda x: (mean[x], x))
        out.append((best, 1 / sum(math.exp(-(m - mean[best]) * min(size, 40)) for m in mean.values()), mean[best]))
    return out


def test_language_id_against_brute_force(spark):
    """Every prediction, score and cross-entropy of a fixture; and rejection just where the cross-entropy is over the limit of texts not seen."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()
    texts = [(r["text"][:400], r["lang"]) for r in docs] + [("", "en"), (None, "en"), ("12 !", "de")]
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    model = language_id.fit(df)
    got = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    for i, (lang, score, entropy) in enumerate(brute_languages([(t, x) for t, x in texts if t and x], [t for t, _ in texts])):
        assert got[i]["lang_pred"] == lang and got[i]["score"] == pytest.approx(score, rel=1e-6)
        assert entropy is None or got[i]["cross_entropy"] == pytest.approx(entropy, rel=1e-9)
        smooth = None if entropy is None else (entropy * got[i]["letters"] + 40 * model.mean.get(lang, entropy)) / (got[i]["letters"] + 40)
        assert got[i]["rejected"] == (lang == "und" or smooth > model.limit.get(lang, math.inf))
    assert 1 < len(model.limit) <= len(model.langs)


def test_language_id_awkward(spark):
    df, rows = awkward(spark)
    out = language_id.identify_held_out(df).collect()
    assert len(out) == len(rows) and {r["lang_pred"] for r in out} == {"en", "und"}
    assert {r["doc_id"] for r in out if r["lang_pred"] == "und"} == {3, 4, 6, 9}
    assert language_id.identify_held_out(df.filter("false")).count() == 0
    assert {r["lang_pred"] for r in language_id.identify_held_out(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_id_keeps_every_gram(spark):
    """A language of half a million four-grams, each of them commoner than any of a rare language of one text."""
    rng = np.random.default_rng(5)
    big = ["".join(map(chr, row)) for row in rng.integers(0x4E00, 0x9F00, (500, 1000))]
    rare = "the quick brown fox jumps over the lazy dog"
    docs = spark.createDataFrame([(t, "big") for t in big for _ in range(2)] + [(rare, "rare")], "text string, lang string").repartition(4)
    model = language_id.fit(docs)
    want = [len(np.unique(language_id.grams(texts)[0])) for texts in (big, [rare])]
    assert model.langs == ["big", "rare"] and want[0] > 450_000
    assert [len(m.probability[-1].hashes) for m in model.models] == want
    asked = spark.createDataFrame([(1, "the lazy brown fox"), (2, big[0][:200])], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identify(asked, model).collect()} == {1: "rare", 2: "big"}


def test_language_id_calibrates_on_every_text(spark):
    """Means and limits by hand: each text, scored by a model of the texts of the other folds, takes part."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").filter("lang is not null").limit(150).collect()
    texts = [(r["text"][:300], r["lang"]) for r in rows] + [("ein einziger kurzer satz einer sprache für sich", "one")]
    df = spark.createDataFrame(texts, "text string, lang string").repartition(3)
    fold = {r[0]: r[1] for r in df.select("text", F.expr(f"cast(pmod(xxhash64(text), {language_id.FOLDS}) as int)")).collect()}
    chars = len(np.unique(language_id.grams([t for t, _ in texts])[0] & np.uint64(0xFFFF)))
    found = defaultdict(list)
    for i in range(language_id.FOLDS):
        others = language_id.Model([], [])
        for lang in sorted({x for t, x in texts if fold[t] != i}):
            codes, _ = language_id.grams([t for t, x in texts if x == lang and fold[t] != i])
            others.langs.append(lang)
            others.models.append(language_id.KneserNey.fit(*np.unique(codes, return_counts=True), chars))
        asked = [t for t, x in texts if fold[t] == i and x in others.langs]
        for loss, n in zip(*others.loss(asked)):
            if n:
                found[others.langs[int(loss.argmin())]].append((float(loss.min()), int(n)))
    assert sum(map(len, found.values())) == sum(n > 0 for n in language_id.grams([t for t, x in texts if x != "one"])[1])
    model = language_id.fit(df, quantile=0.9)
    assert model.langs == sorted({x for _, x in texts}) and set(model.mean) == set(model.limit) == set(found)
    for lang, own in found.items():
        mean = sum(x for x, _ in own) / sum(n for _, n in own)
        smooth = sorted((x + language_id.PRIOR * mean) / (n + language_id.PRIOR) for x, n in own)
        assert model.mean[lang] == pytest.approx(mean, rel=1e-9)
        assert model.limit[lang] == pytest.approx(smooth[math.ceil(0.9 * len(own)) - 1] * language_id.MARGIN, rel=1e-9)


def test_exact_quantiles(spark):
    rng = random.Random(8)
    rows = [(lang, rng.choice([1.25, 1.2500001, rng.gauss(2, 0.0003), rng.random()])) for lang in "ab" for _ in range(20_000)] + [("c", 3.0)]
    df = spark.createDataFrame(rows, "lang_pred string, v double").repartition(4)
    for share in (0.0, 0.5, 0.999, 1.0):
        got = language_id._quantile(df, F.col("v"), share)
        for lang in "abc":
            own = sorted(v for x, v in rows if x == lang)
            assert got[lang] == own[max(1, math.ceil(share * len(own))) - 1]
    assert language_id._quantile(df.filter("false"), F.col("v"), 0.5) == {}


# --- op5


def brute_audit(ours, theirs):
    """{(id, digest): (status, copies, their copies)} of two lists of (id, bytes)."""
    sides = [Counter((i, hashlib.sha256(r).hexdigest()) for i, r in x) for x in (ours, theirs)]
    short, more = ({k[0] for k in sides[0] | sides[1] if sign * (sides[0][k] - sides[1][k]) > 0} for sign in (1, -1))
    out = {}
    for k in sides[0] | sides[1]:
        a, b = sides[0][k], sides[1][k]
        out[k] = ("ok" if a == b else ("damaged" if k[0] in more else "missing") if a > b else "altered" if k[0] in short else "added", a, b)
    return out


def test_fixity(spark, tmp_path):
    pages = [(i, f"http://h/{i}", "<p>é</p>" * (i % 7)) for i in range(1200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    df.coalesce(1).write.parquet(f"{tmp_path}/p")
    stored = fixity.records(df.withColumn("file", F.lit(1)).repartition(3))
    ours, theirs = fixity.drill(stored)
    out = fixity.audit(fixity.manifest(ours), fixity.manifest(theirs))
    rows = [tuple(r) for r in out.collect()]
    assert comparable(out.columns, rows) == sql_rows("op5_fixity", {"pages": f"{tmp_path}/p/*.parquet"})[1]
    assert {r["status"] for r in out.collect()} == {"ok", "damaged", "altered", "missing", "added"}
    same = fixity.audit(fixity.manifest(ours), fixity.manifest(ours))
    assert same.filter("status <> 'ok' or descended").count() == 0


def test_fixity_of_replicas_placed_on_their_own(spark, monkeypatch):
    """Losses, additions, damage and repeats in one file are found, and nothing else; offsets are those of each replica."""
    ours = [(i, b"record %d" % (i % 40) * (1 + i % 3)) for i in range(512)] + [(7, b"twice"), (7, b"twice"), (None, b"nameless"), (None, b"other"), (-5, b"below"), (2**62, b"far")]
    theirs = [(i, r[:-1] + b"?") if i in (9, 300) else (i, r) for i, r in ours if i != 3]
    theirs += [(1000, b"new"), (20, ours[20][1]), (-5, b"more"), (None, b"third")]
    theirs.remove((7, b"twice"))
    monkeypatch.setattr(fixity, "PART_RECORDS", 100)
    sides = [fixity.manifest(spark.createDataFrame([(i, bytearray(r)) for i, r in x], "record_id long, record binary").repartition(3)) for x in (ours, theirs)]
    got = fixity.audit(*sides).collect()
    want = brute_audit(ours, theirs)
    assert {(r["record_id"], r["digest"]): (r["status"], r["copies"], r["their_copies"]) for r in got} == want and len(got) == len(want)
    assert sum(s == "missing" for s, _, _ in want.values()) == 2 and sum(s == "damaged" for s, _, _ in want.values()) == 2
    ranges = {None if i is None else i >> 4 for (i, _), (s, _, _) in want.items() if s != "ok"}
    assert all(r["descended"] == ((None if r["record_id"] is None else r["record_id"] >> 4) in ranges) for r in got)
    # the records of each part lie one after the other
    for x, side in zip((ours, theirs), sides):
        at, total = {}, 0
        for r in side.orderBy("file", "part", "record_offset").collect():
            assert at.get((r["file"], r["part"]), 0) == r["record_offset"]
            at[r["file"], r["part"]] = r["record_offset"] + r["copies"] * r["length"]
            total += r["copies"]
        assert total == len(x) and max(p for _, p in at) >= 2


def test_fixity_finds_one_lost_record(spark):
    stored = fixity.records(spark.range(512).select(F.col("id").alias("page_id"), F.lit("http://h/").alias("url"), F.lit("x").alias("html")))
    found = fixity.audit(fixity.manifest(stored), fixity.manifest(stored.filter("record_id <> 3")))
    assert {(r["status"], r["descended"]): r["count"] for r in found.groupBy("status", "descended").count().collect()} == {("missing", True): 1, ("ok", True): 15, ("ok", False): 496}


def test_fixity_awkward(spark):
    df = spark.createDataFrame([(None, None, None), (-5, "u", ""), (7, "u", "x"), (7, "u", "x"), (10**9, "v", "y" * 10**6)], "page_id long, url string, html string")
    stored = fixity.records(df)
    leaf, named, none = (fixity.manifest(x) for x in (stored, stored.filter("record_id is not null"), stored.filter("false")))
    assert fixity.audit(leaf, named).filter("status = 'missing'").count() == 1 == fixity.audit(named, leaf).filter("status = 'added'").count()
    assert fixity.audit(leaf, leaf).agg(F.sum("copies")).first()[0] == 5 and fixity.audit(none, leaf).filter("status = 'added'").count() == 4
    assert fixity.audit(none, none).count() == 0


def test_read_warc(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h/{i}", "é\r\n\r\n" * i) for i in range(5)], "page_id long, url string, html string")
    stored = [bytes(r["record"]) for r in fixity.records(df).orderBy("record_id").collect()]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc").write_bytes(b"".join(stored))
    (tmp_path / "w" / "b.warc").write_bytes(b"".join(stored)[:-3])
    got = fixity.read_warc(spark, str(tmp_path / "w")).orderBy("path", "record_offset").collect()
    assert [bytes(r["record"]) for r in got if r["record"] is not None] == stored + stored[:4]
    assert [r["error"] is None for r in got].count(False) == 1
    assert stored[0].count(b"WARC-Record-ID: <urn:uuid:") == 1 == stored[0].count(b"\r\nWARC-Date: ") and b"WARC-Type: resource" in stored[0]
    placed = fixity.manifest(fixity.records(df)).orderBy("record_id").collect()
    assert [r["record_offset"] for r in placed] == [r["record_offset"] for r in got][:5]


# --- op6


def sets_of(rows, k=3):
    out = []
    for text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        out.append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    return out


def brute_components(ids, texts, k=3, percent=85):
    sets, forest = sets_of(texts, k), near_dedup.Forest()
    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                forest.join(i, j)
    least = defaultdict(list)
    for i, x in enumerate(ids):
        if x is not None:
            least[forest.root(i)].append(x)
    return sets, [min(least[forest.root(i)], default=None) for i in range(len(ids))]


def near_copies(n, seed=7):
    """Copies of one text with a few words changed, around the threshold, and copies of those."""
    rng, rows = random.Random(seed), []
    base = [f"w{i}" for i in range(150)]
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append(" ".join(own))
    return rows + rows[: n // 3]


@pytest.mark.parametrize(("block", "salted", "k", "percent", "exact"), [(192, 256, 3, 85, False), (8, 16, 3, 85, False), (16, 4, 5, 80, False), (8, 16, 3, 85, True), (192, 256, 5, 80, True)])
def test_near_dedup(spark, monkeypatch, block, salted, k, percent, exact):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "SALTED", salted)
    texts = near_copies(90) + [f"other text number {i} of no kin at all" for i in range(30)]
    ids = list(range(1000, 1000 + len(texts)))
    random.Random(block).shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(df, shingle_words=k, percent=percent, bands=20, exact=exact).collect()}
    sets, want = brute_components(ids, texts, k, percent)
    assert len(set(want)) > 35
    assert [(got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) for i in ids] == [(len(s), c, i == c) for i, s, c in zip(ids, sets, want)]


def test_near_dedup_awkward(spark):
    df, rows = awkward(spark)
    out = near_dedup.near_duplicates(df)
    got = sorted(map(tuple, out.collect()), key=str)
    sets, want = brute_components([r[0] for r in rows], [r[1] for r in rows])
    want = [(r[0], len(s), c, True if c is None else r[0] == c) for r, s, c in zip(rows, sets, want)]
    assert got == sorted(want, key=str)
    assert near_dedup.near_duplicates(df.filter("false")).count() == 0


def test_prefix():
    """Two sets that are just similar enough share a hash of their prefixes, in whatever order their common part lies."""
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 20, 100, 333):
        for percent in (80, 85, 100):
            for _ in range(30):
                pool = rng.integers(0, 2**62, 2 * n + 1).astype(np.uint64)
                a = np.unique(pool[:n])
                b = np.unique(np.concatenate([rng.permutation(a)[: max(1, -(-percent * n // 100))], pool[n : n + n // 20]]))
                if near_dedup.similar(len(np.intersect1d(a, b)), len(a), len(b), percent):
                    assert len(np.intersect1d(near_dedup.prefix(a, percent), near_dedup.prefix(b, percent)))


def test_blocks_of_one_large_component(spark, monkeypatch):
    """All pairs of different components meet, and a node of a large component goes to few tasks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    comps = [0] * 200 + [1] * 30 + list(range(2, 14))
    rows = [(7, i, 5, 0, c, 3, i % 3) for i, c in enumerate(comps)]
    out = near_dedup._blocks(spark.createDataFrame(rows, "key long, node long, n long, rep long, comp long, salts int, salt int")).collect()
    by = defaultdict(set)
    for r in out:
        by[r["task"]].add(r["node"])
    met = {(a, b) for nodes in by.values() for a in nodes for b in nodes if comps[a] != comps[b]}
    assert len(met) == sum(a != b for a in comps for b in comps)
    copies = Counter(r["node"] for r in out)
    assert max(copies[i] for i in range(200)) <= 6


def test_super_minhash():
    """The batch equals the element-by-element algorithm, and its share of equal slots estimates the similarity."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 5, 40, 700)] + [np.zeros(0, np.uint64)]
    together = near_dedup.super_minhash(sets, 32)
    for s, row in zip(sets, together):
        assert (near_dedup.super_minhash([s], 32)[0] == row).all()
        if len(s):
            assert (np.minimum.reduce([near_dedup.super_minhash([s[i : i + 1]], 32)[0] for i in range(len(s))]) == row).all()
            assert sorted(x >> near_dedup.FRACTION_BITS for x in near_dedup.super_minhash([s[:1]], 32)[0].tolist()) == list(range(32))
    both = rng.integers(0, 2**63, (300, 150)).astype(np.uint64)
    share = [np.mean(np.equal(*near_dedup.super_minhash([np.unique(x[:120]), np.unique(x[30:])], 64))) for x in both]
    assert abs(np.mean(share) - 0.6) < 0.02 and np.std(share) < math.sqrt(0.6 * 0.4 / 64)


def test_words():
    texts = ["One  two\tthree", "", "é one", " ", "two three", "THREE two one", "x" * 3_000_000, "a " * 700_000 + "end"]
    data = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    found, counts = words.word_hashes(np.frombuffer(data, np.uint8), offsets)
    assert counts.tolist() == [len(t.split()) for t in texts]
    names = " ".join(texts).lower().split()
    assert len({(a, int(b)) for a, b in zip(names, found)}) == len(set(names)) == len(set(found.tolist()))
    alone = words.word_hashes(np.frombuffer(texts[-1].encode(), np.uint8), np.array([0, len(texts[-1])]))[0]
    assert (alone == found[-len(alone) :]).all()


# --- op7


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_bpe())


PARTS = ["a", "th", "'", "s", "'re", "é", "é", "́", "日本", "한국", "ᄒ", "ᅡ", "ᆫ", " ", "  ", "\n", "\x1c", "\x85", "12", "½", "Σ", "İ", "!!", "<|endoftext|>", "<|endo", "𝔘", "😀", "the", "ing", "_", "हि", "Ⱥ", "ª"]


def test_bpe_against_the_library(library):
    rng, encoder = random.Random(3), bpe.Encoder(bpe.Vocabulary(word_bpe()))
    assert 0 < encoder.v.lookahead < 1000
    for _ in range(1500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30)))
        assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_bpe_streams(library, monkeypatch):
    monkeypatch.setattr(bpe, "FEED", 16)
    rng, encoder = random.Random(4), bpe.Encoder(bpe.Vocabulary(word_bpe()))
    for n in range(600):
        kinds = PARTS if n % 2 else ["ing", "e", "th", "an", "s"]
        text = "".join(rng.choice(kinds) for _ in range(rng.randint(0, 30 if n % 2 else 500)))
        out, at = [], 0
        encoder.reset()
        while at < len(text):
            to = at + rng.randint(1, 9)
            out += encoder.feed(text[at:to])
            at = to
        out += encoder.finish()
        assert out == library.encode(text, add_special_tokens=False).ids
    assert encoder.most_held < 2 * encoder.v.lookahead


def test_bpe_constant_memory(library):
    encoder = bpe.Encoder(bpe.Vocabulary(word_bpe()))
    for text in ("".join(random.Random(1).choice("abcdefgh") for _ in range(400_000)), "'" * 100_000, "日本" * 50_000, "!?" * 50_000):
        assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids
        assert encoder.most_held < 2 * bpe.FEED


def test_bpe_feeds_every_text(spark, library):
    """Of all documents, whatever their length, tokens leave as soon as they are final: what is left to the end is a word's tail."""
    encoder, total = bpe.Encoder(bpe.Vocabulary(word_bpe())), 0
    for (text,) in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        before = encoder.finished
        ids = encoder.encode(text)
        total += len(ids)
        assert ids == library.encode(text, add_special_tokens=False).ids and encoder.finished - before <= encoder.v.lookahead + 32
    assert encoder.fed + encoder.finished == total and encoder.fed > 0.95 * total


def test_bpe_refuses_other_files(tmp_path):
    with open(word_bpe(), encoding="utf-8") as f:
        spec = json.load(f)
    for key, value in (("normalizer", {"type": "NFKC"}), ("pre_tokenizer", None), ("added_tokens", [{"id": 1, "content": "<x>", "lstrip": True}]), ("decoder", {"type": "WordPiece"}), ("model", {**spec["model"], "byte_fallback": True})):
        with open(tmp_path / "t.json", "w") as f:
            json.dump({**spec, key: value}, f)
        with pytest.raises(ValueError, match="not supported"):
            bpe.Vocabulary(str(tmp_path / "t.json"))


def test_bpe_decodes(spark, library):
    v = bpe.Vocabulary(word_bpe())
    ids = library.encode("Hello, wörld! 日本 😀", add_special_tokens=False).ids
    d = bpe.Decoder(v)
    assert "".join(d.feed([i]) for i in ids) + d.finish() == library.decode(ids, skip_special_tokens=False)
    d = bpe.Decoder(v, as_bytes=True)
    assert "".join(d.feed([i]) for i in ids) + d.finish() == "hello , wörld ! 日本 😀 "
    df, rows = awkward(spark)
    round_ = bpe.decode(bpe.encode(df, word_bpe()), word_bpe())
    assert sorted((r["doc_id"] or -1, r["text"]) for r in round_.collect()) == sorted((r[0] or -1, library.decode(library.encode(r[1] or "", add_special_tokens=False).ids, skip_special_tokens=False)) for r in rows)


def test_bpe_digests(spark, library):
    df, rows = awkward(spark)
    want = []
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe.digests(df, word_bpe()).collect()), key=str) == sorted(want, key=str)
    assert bpe.digests(df.filter("false"), word_bpe()).count() == 0


# --- op8


def test_mixing_weights(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 10, "tiny").when(F.col("id") < 5000, "big").otherwise("mid").alias("source"))
    out = mixing.poisson_mix(docs, weights={"tiny": 1.0, "big": 1.0}, total=20_000)
    got = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert set(got) == {"tiny", "big"} and all(abs(n - 10_000) < 500 for n in got.values())
    assert out.filter("source = 'tiny'").groupBy("doc_id").count().agg(F.stddev("count")).first()[0] < 100
    assert out.groupBy("doc_id", "copy").count().filter("count > 1").count() == 0
    assert mixing.poisson_mix(docs.repartition(7), weights={"tiny": 1.0, "big": 1.0}, total=20_000).exceptAll(out).count() == 0
    draws = {r["n_copies"]: r["n"] for r in mixing.poisson_mix(docs, weights={"big": 1.0}, total=4990 * 2).filter("copy = 1").groupBy("n_copies").agg(F.count("*").alias("n")).collect()}
    for k in range(1, 6):
        assert abs(draws[k] - 4990 * math.exp(-2) * 2**k / math.factorial(k)) < 130
    salted = mixing.MOST_BROADCAST
    try:
        mixing.MOST_BROADCAST = 1
        assert mixing.poisson_mix(docs).exceptAll((setattr(mixing, "MOST_BROADCAST", salted), mixing.poisson_mix(docs))[1]).count() == 0
    finally:
        mixing.MOST_BROADCAST = salted


def test_mixing_awkward(spark):
    df, rows = awkward(spark)
    for name in ("__source", "_source", "parts", "_salt"):
        df = df.withColumn(name, F.lit("kept"))
    out = mixing.poisson_mix(df, total=500)
    assert out.filter("__source = 'kept' and _salt = 'kept'").count() == out.count()
    assert out.filter("source is null").count() > 50 and out.filter("doc_id is null").count() > 0
    assert set(df.columns) < set(out.columns)
    assert mixing.poisson_mix(df.filter("false")).count() == 0 == mixing.poisson_mix(df, weights={}).count()


# --- op9


def brute_licences(text, templates):
    """All windows, without MinHash."""
    token = lambda t: re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode().lower())
    out = {}
    w = token(text)
    for name, texts in templates.items():
        for t in texts:
            tw = token(t)
            k = min(5, len(tw))
            grams = [tuple(tw[i : i + k]) for i in range(len(tw) - k + 1)]
            own = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
            half = 1
            while len(grams) > half + 1:
                half *= 2
            for a in range(0, len(own), half):
                places = [i for i in range(a, min(a + 2 * half, len(own))) if own[i] in set(grams)]
                share = len({own[i] for i in places}) / len(set(grams))
                if share >= 0.8 and (name not in out or (share, len(set(grams))) > (out[name][0], out[name][3])):
                    out[name] = (share, places[0], places[-1] + k, len(set(grams)))
    kept = []
    for name, (share, first, past, size) in sorted(out.items(), key=lambda m: (-m[1][0], -m[1][3], m[0])):
        if not any(2 * len(set(range(first, past)) & set(range(a, b))) > min(past - first, b - a) for _, a, b in kept):
            kept.append((name, first, past))
    return ",".join(sorted(x for x, _, _ in kept))


def test_licences(spark):
    rng, rows = random.Random(8), []
    texts = [t for v in licences.TEMPLATES.values() for t in v]
    for i in range(400):
        filler = lambda: " ".join(rng.choice(["alpha", "beta", "rights", "License", "the", "gamma"]) for _ in range(rng.randint(0, 40)))
        t = rng.choice(texts).split()
        if i % 3 == 0:
            t[rng.randrange(len(t))] = "changed"
        rows.append((i, f"{filler()}\n{' '.join(t)} {filler()}"))
    rows += [(None, None), (1000, ""), (1001, "all rights"), (1002, "ALL RIGHTS, reserved")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1)).repartition(3)
    got = {(r["doc_id"], r["licences"]) for r in licences.scan(df).collect()}
    assert got == {(i, brute_licences(t, licences.TEMPLATES)) for i, t in rows}
    match = next(m for r in licences.scan(df).filter("doc_id = 1002").collect() for m in r["matches"])
    assert (match["licence"], match["containment"], match["first_word"], match["past_word"]) == ("All-Rights-Reserved", 1.0, 0, 3)
    assert licences.scan(df.filter("false")).count() == 0


def test_licences_are_told_apart(spark):
    """Each template is found as its own licence alone, whatever neighbours share with it; templates may be a table of long texts."""
    rows = [(name, t) for name, texts in licences.TEMPLATES.items() for t in texts]
    df = spark.createDataFrame([(i, f"some words before {t} and some after it") for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in licences.scan(df).collect()}
    assert [got[i] for i in range(len(rows))] == [name for name, _ in rows]
    rng = random.Random(9)
    long = [" ".join(f"w{rng.randrange(500)}" for _ in range(3000)) for _ in range(2)]
    templates = spark.createDataFrame([("one", long[0]), ("two", long[1]), (None, "x"), ("none", None)], "licence string, text string")
    asked, _ = awkward(spark)
    part = long[0].split()
    asked = asked.select("doc_id", "text").unionByName(spark.createDataFrame([(50, "x " * 700 + long[0]), (51, " ".join(part[:2300])), (52, " ".join(part[:2700]) + " y" * 9000 + " " + long[1]), (52, long[1])], "doc_id long, text string"))
    found = licences.scan(asked, templates=templates).filter("n_licences > 0").collect()
    assert sorted((r["doc_id"], r["licences"]) for r in found) == [(50, "one"), (52, "one,two"), (52, "two")]


# --- op10

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a<b) "</p>"</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav><div class="cookie-notice">We use cookies</div><div id=sidebar>Links</div>
<article><h1>Title &amp; more</h1><p>First&nbsp; <b>bold</b>
text.<br>Next<p>Second &lt;p&gt; 1 &lt; 2<!-- <p>no</p> --><form><input>Send</form><ul><li>One<li>Two</ul><div class="ad">Buy</div>
<table><tr><td>a<td>b<tr><td>c</table></article><section class="comments"><p>Reader says</p></section><aside>Other</aside><footer>F</footer>"""


def test_page():
    text = "\n\n".join(b for _, b in html_text.Page(PAGE).wanted())
    assert text == "Title & more\n\nFirst bold text. Next\n\nSecond <p> 1 < 2\n\nOne\n\nTwo\n\na b\n\nc"
    for odd in ("", "<", "a < b", "<p", "<!--", "<p class='x>y", "<script>", "</p></b>", "<b><i>x</b>y</i>", "&#0; &bogus; &#xD800;", "<" * 5000, "<div>" * 3000 + "x"):
        html_text.Page(odd)
    kept = '<body><div style="overflow:hidden" title="a hidden valley" data-role="search">one</div><p data-id="comment-3">two <code class="hljs-comment">three</code></p>'
    assert [b for _, b in html_text.Page(kept).wanted()] == ["one", "two three"]
    lines = '<div>one <button class=x>Buy</button>two<span class="ad">now <div>cheap</div>!</span> three</div><p>four <i hidden>not</i> <span id="sponsored">five</p><p hidden>six</p><p>seven'
    assert [b for _, b in html_text.Page(lines).wanted()] == ["one two three", "four", "seven"]
    assert [b for _, b in html_text.Page("<body>plain<div>block</div>tail &eacute;").wanted()] == ["plain", "block", "tail é"]


def test_main_text(spark):
    site = lambda i: f"<body><div><p>Welcome to our site</p><ul><li>All topics</ul></div><div><p>Story {i} is told here.</p><p>A line that all share.</p></div><div>Made by us</div></body>"
    article = lambda i: f"<body><article><p>Piece {i}.</p><p>Shared passage.</p></article><div>Made by us</div>"
    rows = [(i, f"http://a.example/{i}", site(i)) for i in range(12)] + [(100 + i, f"https://b.example/{i}", article(i)) for i in range(12)] + [(200, None, None), (201, "x", ""), (202, "http://c.example/", site(1)), (0, "http://a.example/0", site(0)), (None, "http://d.example", "&lt;é")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("gone", F.lit(1)).repartition(4)
    got = sorted((tuple(r)[:4] for r in html_text.main_text(df).collect()), key=str)
    want = [(i, f"http://a.example/{i}", f"Story {i} is told here.\n\nA line that all share.") for i in [*range(12), 0]] + [(100 + i, f"https://b.example/{i}", f"Piece {i}.\n\nShared passage.") for i in range(12)]
    want += [(200, None, ""), (201, "x", ""), (202, "http://c.example/", "Welcome to our site\n\nAll topics\n\nStory 1 is told here.\n\nA line that all share.\n\nMade by us"), (None, "http://d.example", "<é")]
    assert got == sorted([(*w, len(w[2])) for w in want], key=str)
    assert html_text.main_text(df.filter("false")).count() == 0


def test_marks():
    """A wrapper that only mentions a sidebar or comments holds the article; headers of an entry are part of it; an empty article is not the page."""
    story = "<article><div class='entry-header'>A title</div><p>The story, told at some length.</p></article>"
    for name in ("content-sidebar-wrap", "has-sidebar", "no-sidebar", "post has-comments", "site-content", "widget-page", "sidebar", "comments"):
        assert [b for _, b in html_text.Page(f"<body><div class='{name}'>{story}</div><div class='sidebar-left'>Links</div>").wanted()] == ["A title", "The story, told at some length."]
    for name in ("sidebar", "post-comments", "cookie-notice", "main-nav", "site-footer", "ad", "related-posts", "comments-2"):
        assert [b for _, b in html_text.Page(f"<body>{story}<div class='{name}'>Not this</div>").wanted()] == ["A title", "The story, told at some length."]
    bulk = "<body><div id=sidebar><p>All of the text of this page stands here.</p></div><p>End</p>"
    assert len(html_text.Page(bulk).wanted()) == 2
    assert [b for _, b in html_text.Page("<body><article></article><article>Card</article><div><p>The body of the page is elsewhere.</p></div>").wanted()] == ["Card", "The body of the page is elsewhere."]


def host_of(url):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", url or "")
    return m[1].lower() if m else ""


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_main_text_against_counters_of_each_host(spark, sf):
    """Template removal by a dictionary for each host, on all pages."""
    df = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    pages = [(r["page_id"], host_of(r["url"]), html_text.Page(r["html"] or "")) for r in df.collect()]
    size, seen = Counter(h for _, h, _ in pages), defaultdict(set)
    for _, h, page in pages:
        for subtree, _, _ in page.subtrees:
            seen[h, subtree].add(page.digest)
    got = {r["page_id"]: r for r in html_text.main_text(df).collect()}
    removed = 0
    for i, h, page in pages:
        gone = {j for s, a, b in page.subtrees for j in range(a, b) if len(seen[h, s]) >= max(5, math.floor(2 * math.log2(size[h])))}
        removed += bool(gone)
        text = "\n\n".join(b for _, b in page.wanted(gone))
        assert (got[i]["text"], got[i]["n_chars"], got[i]["n_removed"]) == (text, len(text), len(gone))
        # what is left is the article, whichever way the rest went
        assert text == "\n\n".join(b for b, k, w in zip(page.blocks, page.kept, page.within) if k and w)
    assert removed > 0.5 * len(pages)


# --- pipeline


def test_pipeline(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = corpus_pipeline.keep_known_languages(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * len(rows)
    one = corpus_pipeline.keep_one_of_near_copies(spark, kept, SF)
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    want = {i for i, c in zip(ids, brute_components(ids, [rows[i]["text"] for i in ids], 5, 80)[1]) if i == c}
    assert {r["doc_id"] for r in one.collect()} == want and one.columns == docs.columns
    mixed = corpus_pipeline.mix_sources(spark, one, SF)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= want
    out = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r["doc_id"] for r in mixed.collect())
    for r in out[:50]:
        assert r["ids"] == library.encode(rows[r["doc_id"]]["text"], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


def test_pipeline_keeps_one_row_of_each_group(spark):
    """Null ids and ids of several texts go by their own texts."""
    texts = near_copies(60) + [f"other text number {i} of no kin at all" for i in range(20)] + ["", None, "", None]
    rng = random.Random(4)
    ids = [rng.choice([None, *range(25)]) for _ in texts]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in zip(ids, texts)], DOC).repartition(3)
    sets, group = brute_components(list(range(len(texts))), texts, 5, 80)
    members = defaultdict(list)
    for i, t, s, g in zip(ids, texts, sets, group):
        members[g if s else (i, t)].append((i is None, i or 0, t))
    out = [(r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_near_copies(spark, df, SF).collect()]
    assert len(out) == len(members) > 30
    for rows in members.values():
        least = min(r[:2] for r in rows)
        mine = [o for o in out if (o[0] is None, o[0] or 0, o[1]) in rows]
        assert len(mine) == 1 and (mine[0][0] is None, mine[0][0] or 0) == least


def test_pipeline_learns_from_every_row(spark):
    """A language of rows that op4 would hold out, and one of rows without an id, are learned too; one that no row teaches is dropped."""
    rng = random.Random(9)
    write = lambda first: " ".join("".join(chr(first + rng.randrange(24)) for _ in range(4)) for _ in range(30))
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    rows = [(i, write(0x61), "a", "s", 1) for i in range(100) if i not in held] + [(i, write(0x430), "b", "s", 1) for i in held[:30]]
    rows += [(None, write(0x3B1), "c", "s", 1) for _ in range(30)]
    unknown = [(i, write(0x10D0), None, "s", 1) for i in range(500, 510)]
    kept = corpus_pipeline.keep_known_languages(spark, spark.createDataFrame(rows + unknown, DOC).repartition(3), SF)
    assert sorted(r["text"] for r in kept.collect()) == sorted(r[1] for r in rows)


def test_pipeline_awkward(spark, tmp_path):
    df, _ = awkward(spark)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    df.filter("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
