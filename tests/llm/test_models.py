import collections
import hashlib
import math
import random
import re
import string
import struct
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumengrid.llm import language, qualityclass, queries, sentencepieces
from lumengrid.llm.common import crc_fold, table

DOCS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def model_path():
    pytest.importorskip("public_tokenizers")
    return queries.piece_model()


@pytest.fixture(scope="module")
def library(model_path):
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=model_path)


TEXTS = [None, "", " ", "  a b", "a\nb  c", "a\x00b", "Ａ½ é x", "▁x  y▁", "x   ", "日本語 text 🎉🎉 y", "<s> </s><unk>", "long " * 20_000, "x" * 5000, "a b", "a b"]


def test_pieces_are_the_library_s(spark, model_path, library):
    docs = spark.createDataFrame([(k, t, "keep") for k, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    out = sentencepieces.encode(docs, model_path, carry=["doc_id", "ids"]).collect()
    assert len(out) == len(TEXTS)
    for r in out:
        text = TEXTS[r.doc_id] or ""
        wanted = library.encode(text, add_bos=True, add_eos=True)
        assert list(struct.unpack(f"<{len(wanted)}I", r.ids)) == wanted and r.n_tokens == len(wanted)
        assert r.decoded == library.decode(wanted)
        spans = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert list(zip(r.begins, r.ends, strict=True))[1:-1] == spans


def test_pieces_of_the_tables(spark, sf_dir, library):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents", "doc_id", "text").collect()}
    for r in queries.op9_sentencepiece(spark, sf_dir).collect():
        ids = library.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_spans_of_the_tables(spark, sf_dir, library):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents", "doc_id", "text").collect()}
    for r in queries.op9_sentencepiece(spark, sf_dir).collect():
        spans = [(p.begin, p.end) for p in library.encode(docs[r.doc_id], return_type="proto").pieces]
        end = len(docs[r.doc_id].encode())
        assert r.spans_sha256 == hashlib.sha256(np.array([(0, 0), *spans, (end, end)], "<u4").tobytes()).hexdigest()


def test_alignment_without_a_character_map(model_path):
    with open(model_path, "rb") as file:
        encoder = sentencepieces.Encoder(file.read())
    for text in filter(None, TEXTS):
        wanted = [0] * 3 if encoder.dummy else []
        at = 0
        for c in text:
            wanted += [at] * (3 if c == " " else len(c.encode()))
            at += len(c.encode())
        found, source = encoder.normalise(text)
        assert found == ("▁" if encoder.dummy else "") + text.replace(" ", "▁") and source.tolist() == [*wanted, at]


def test_spans_must_cover_the_text(model_path):
    with open(model_path, "rb") as file:
        encoder = sentencepieces.Encoder(file.read())
    normal, source = encoder.normalise("some text")
    ids = np.frombuffer(encoder.encode([normal])[0], "<u4")
    assert encoder.spans(ids, source)[1][-1] == 9
    with pytest.raises(ValueError):
        encoder.spans(ids[:-1], source)


def test_compiled_character_map():
    sentencepiece = pytest.importorskip("sentencepiece")
    normaliser = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc_cf")
    spec = dict(sentencepieces._fields(dict(sentencepieces._fields(normaliser.serialized_model_proto()))[3]))
    encoder = sentencepieces.Encoder.__new__(sentencepieces.Encoder)
    encoder.map, encoder.dummy, encoder.trim, encoder.escape = sentencepieces.CharMap(spec[2]), True, True, True
    for text in ("Ａ½ é x", "ﬁ ②Ⅳ  Straße ŻÓŁĆ", "カ゛ｶﾞ ㍿", "a\tb　c", "  a   b  ", " ", ""):
        found, source = encoder.normalise(text)
        assert found == normaliser.normalize(text), text
        assert len(source) == len(found.encode()) + 1 and source[-1] <= len(text.encode()) and (np.diff(source) >= 0).all()


def test_pieces_without_rows(spark, model_path):
    assert sentencepieces.encode(spark.createDataFrame([], DOCS), model_path).count() == 0


def test_language_of_held_out_documents(spark, sf_dir):
    out = queries.op3_language(spark, sf_dir).join(table(spark, sf_dir, "documents", "doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert len(held) and (held.lang == held.lang_pred).mean() >= 0.98 and out.score.between(0, 1).all()


def test_language_of_odd_rows(spark):
    rows = [(k, "the cat and the dog", "en", "s") for k in range(20)] + [(k, "der hund und die katze", "de", "s") for k in range(20, 40)] + [(40, None, "en", "s"), (41, "the", None, "s")]
    docs = spark.createDataFrame(rows, DOCS)
    model = language.fit(docs)
    asked = spark.createDataFrame([(1, "the dogs"), (2, "hunde"), (3, None), (4, ""), (5, "12 !? 34"), (6, "the " * 50_000), (7, "ж"), (None, "und")], "doc_id long, text string")
    out = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(asked, model, carry=["doc_id"]).collect()}
    assert out[1][0] == out[6][0] == "en" and out[2][0] == out[None][0] == "de"
    assert out[3] == out[4] == out[5] == ("und", 0.0) and out[7][0] in ("de", "en") and 0 <= out[7][1] <= 1
    empty = language.fit(spark.createDataFrame([], DOCS))
    assert {r.lang_pred for r in language.predict(asked, empty).collect()} == {"und"}


def plain_words(text):
    """Letters and the marks after them, by category."""
    found = [""]
    for c in (text or "").lower():
        kind = unicodedata.category(c)[0]
        found[-1:] = [found[-1] + c] if kind == "L" or kind == "M" and found[-1] else [found[-1], ""]
    return [w for w in found if w]


def plain_language(train, texts, least=1, most=3.0, evidence=20):
    """The same backoff, letter by letter."""
    words = plain_words
    grams = lambda w, n: [g[i : i + n] for g in [f"<{w}>" if n > 1 else w] for i in range(len(g) - n + 1)] or [f"<{w}>"]
    langs = sorted({lang for lang, _ in train})
    counts = {(n, lang): collections.Counter() for n in range(5) for lang in langs}
    for lang, text in train:
        for w in words(text):
            counts[0, lang][w] += 1
            for n in (4, 3, 2, 1):
                counts[n, lang].update(grams(w, n))
    kept = {k: {x: c for x, c in v.items() if c >= least or k[0] == 1} for k, v in counts.items()}
    vocabulary = {n: set().union(*[kept[n, lang] for lang in langs]) for n in range(5)}
    log = lambda n, x, lang: math.log((kept[n, lang].get(x, 0) + 0.5) / (sum(kept[n, lang].values()) + 0.5 * len(vocabulary[n])))

    def score(w):
        if w in vocabulary[0]:
            return [log(0, w, lang) for lang in langs]
        for n in (4, 3, 2, 1):
            if known := [g for g in grams(w, n) if g in vocabulary[n]]:
                return [sum(log(n, g, lang) for g in known) / len(known) for lang in langs]
        return [0.0] * len(langs)

    out = []
    for text in texts:
        rows = [(score(w), 1 if w in vocabulary[0] else max(1, len(w) / 60)) for w in words(text)]
        if not rows:
            out.append(("und", 0.0))
            continue
        total = [sum(weight * max(r[k] - max(r), -most) for r, weight in rows) for k in range(len(langs))]
        best = max(range(len(langs)), key=lambda k: total[k])
        n = sum(weight for _, weight in rows)
        out.append((langs[best], 1 / sum(math.exp((x - total[best]) / n * min(n, evidence)) for x in total)))
    return out


def test_language_of_the_tables_matches_plain_python(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumn("fold", crc_fold("doc_id")).collect()
    wanted = plain_language([(d.lang, d.text) for d in docs if d.fold != 2 and d.lang is not None and d.text is not None], [d.text for d in docs])
    found = {r.doc_id: r for r in queries.op3_language(spark, sf_dir).collect()}
    for d, (lang, score) in zip(docs, wanted, strict=True):
        assert found[d.doc_id].lang_pred == lang and found[d.doc_id].score == pytest.approx(score, abs=1e-6)


def test_language_with_columns_of_results_names(spark):
    docs = spark.createDataFrame([(k, "the cat" if k % 2 else "der hund", "en" if k % 2 else "de", 5, 6) for k in range(8)], "doc_id long, text string, lang string, lang_pred int, score int")
    out = language.predict(docs, language.fit(docs))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and all(r.lang == r.lang_pred for r in out.collect())
    assert language.predict(docs.limit(0), language.fit(docs)).count() == 0


def test_word_backoff_uses_shorter_grams():
    model = language.Model([("a", 0, "abc", 5), ("b", 0, "xyz", 5), ("a", 3, "<ab", 4), ("b", 3, "<xy", 4), ("a", 1, "q", 9), ("b", 1, "r", 9)])
    predict = language.Predictor(model).predict
    assert [lang for lang, _ in predict(["abc", "abd", "xyd", "rrr", "qqq"])] == ["a", "a", "b", "b", "a"]
    small = language.Predictor(model, cache_entries=2).predict
    assert [small([w])[0] for w in ("abc", "abd", "xyd", "rrr", "qqq")] == predict(["abc", "abd", "xyd", "rrr", "qqq"])


def test_long_runs_of_letters_are_scored_whole():
    model = language.Model([("a", 4, "abab", 5), ("b", 4, "xyxy", 5), ("a", 1, "a", 9), ("b", 1, "x", 9)])
    predict = language.Predictor(model).predict
    assert [lang for lang, _ in predict(["ab" * 35 + "xy" * 300, "xy" * 35 + "ab" * 300, "ab" * 20])] == ["b", "a", "a"]
    scores = [score for _, score in predict(["ab" * k + "xy" * (k // 3) for k in range(15, 75)])]
    assert {lang for lang, _ in predict(["ab" * k + "xy" * (k // 3) for k in range(15, 75)])} == {"a"}
    assert max(abs(x - y) for x, y in zip(scores, scores[1:], strict=False)) < 0.05
    few = language.Predictor(model, cache_characters=100).predict
    assert [few([t])[0] for t in ("ab" * 40, "xy" * 200, "ab" * 40)] == predict(["ab" * 40, "xy" * 200, "ab" * 40])


@pytest.mark.parametrize("text", ["½ ² ³", "Ⅷ", "①②", "\u0301 \u093f", "12 !? ٣", "🎉"])
def test_texts_without_a_letter(text):
    model = language.Model([("a", 1, "a", 9), ("b", 1, "x", 9)])
    assert language.Predictor(model).predict([text]) == [("und", 0.0)]


def test_words_with_marks_are_whole():
    assert language.words_of("हिन्दी भाषा, สวัสดี! Ärger2x e\u0301t\u00e9 a_b") == ["हिन्दी", "भाषा", "สวัสดี", "ärger", "x", "e\u0301té", "a", "b"]
    for text in ("हिन्दी भाषा ½x", "\u0301a\u0301 b", "İstanbul ÀB", "", "日本語 テキスト"):
        assert language.words_of(text) == plain_words(text)


def test_languages_agree_with_plain_python_on_odd_words(spark):
    rng = random.Random(3)
    spell = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    letters = {"x": "abcdeé", "y": "cdefgh", "z": "हिनदभाषऔ"}
    train = [(lang, " ".join(spell(s, rng.randrange(1, 9)) for _ in range(30))) for lang, s in letters.items() for _ in range(12)]
    texts = [" ".join(spell(letters[rng.choice("xyz")], rng.choice([2, 5, 59, 60, 61, 130, 400])) for _ in range(rng.randrange(1, 6))) for _ in range(80)] + ["½", "cd dc", ""]
    docs = spark.createDataFrame([(k, t, lang, None) for k, (lang, t) in enumerate(train)], DOCS)
    model = language.fit(docs)
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r, (lang, score) in zip(language.predict(asked, model).orderBy("doc_id").collect(), plain_language(train, texts), strict=True):
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-6)


def test_equal_languages_go_to_the_smaller_name():
    model = language.Model([("b", 0, "same", 3), ("a", 0, "same", 3), ("c", 0, "same", 3)])
    assert language.Predictor(model).predict(["same same"])[0] == ("a", pytest.approx(1 / 3))


def test_sample_is_bounded_by_characters(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "wort " * 50, "de", None) for k in range(400)] + [(k, f"word{k}", "en", None) for k in range(400, 600)], DOCS)
    seen = []
    monkeypatch.setattr(language, "Model", lambda counted: seen.append(counted))
    language.fit(docs, characters=20_000)
    words = {(r["lang"], r["item"]): r["c"] for r in seen[0].to_pylist() if r["n"] == 0}
    assert 5 * words["de", "wort"] < 20_000 and words["de", "wort"] % 50 == 0 and words["en", "word"] == 200


def test_quality_of_held_out_documents(spark, sf_dir):
    out = queries.op10_quality(spark, sf_dir).join(table(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id").toPandas()
    held = out[out.held_out]
    assert len(held) and ((held.score >= 0.7) == (held.quality == 1)).mean() >= 0.9


def test_discriminant_matches_dense_formula(spark):
    rng = np.random.default_rng(2)
    d = len(qualityclass.STATISTICS)
    x = np.concatenate([rng.normal(0, 1, (80, d)), rng.normal(1, 2, (60, d))])
    y = [1] * 80 + [0] * 60
    rows = spark.createDataFrame([(v.tolist(), k) for v, k in zip(x, y, strict=True)] + [(x[0].tolist(), 7), (x[0].tolist(), None)], "stats array<double>, quality int")
    model = qualityclass.fit(rows, shrink=0.1, pool=0.2, ridge=1e-3)
    covs = [np.cov(x[np.array(y) == k].T, bias=True) for k in (0, 1)]
    pooled = (60 * covs[0] + 80 * covs[1]) / 140
    density = []
    for k in (0, 1):
        cov = 0.7 * covs[k] + 0.1 * np.diag(np.diag(covs[k])) + 0.2 * pooled + 1e-3 * np.eye(d)
        away = x - x[np.array(y) == k].mean(0)
        density.append(-0.5 * np.einsum("ni,ij,nj->n", away, np.linalg.inv(cov), away) - 0.5 * np.linalg.slogdet(cov)[1])
    assert model.scores(x) == pytest.approx(1 / (1 + np.exp(density[0] - density[1] - np.log(80 / 60))), rel=1e-6)


def plain_statistics(text):
    text = text or ""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, count = len(words), lambda chars: sum(text.count(c) for c in chars)
    capitals, small = count(string.ascii_uppercase), count(string.ascii_lowercase)
    log, root = math.log, math.sqrt
    return [
        log(n + 10), log((sum(map(len, words)) + 50) / (n + 10)), root(count("#*$%&|<>") / (n + 10)), root((capitals + 1) / (capitals + small + 20)), root(count(string.digits) / (len(text) + 50)),
        root((count(".,;:-'\"()") + 2) / (n + 10)), log((len(set(words)) + 10) / (n + 10)), root(sum(a == b for a, b in zip(words, words[1:])) / (n + 10)), log((n + 10) / (len(lines) + 1)),
        root((len(lines) - len(set(lines))) / (len(lines) + 10)), root(count("!?") / (n + 10)),
    ]


def test_quality_of_the_tables_matches_numpy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("fold", crc_fold("doc_id")).collect()
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels", "doc_id", "quality").collect()}
    x = np.array([plain_statistics(d.text) for d in docs])
    taught = np.array([labels.get(d.doc_id) if d.fold != 2 and labels.get(d.doc_id) in (0, 1) else -1 for d in docs])
    covs = [np.cov(x[taught == k].T, bias=True) for k in (0, 1)]
    counts = [(taught == k).sum() for k in (0, 1)]
    pooled = (counts[0] * covs[0] + counts[1] * covs[1]) / sum(counts)
    density = []
    for k in (0, 1):
        cov = 0.9 * covs[k] + 0.05 * np.diag(np.diag(covs[k])) + 0.05 * pooled + 1e-3 * np.eye(len(x[0]))
        away = x - x[taught == k].mean(0)
        density.append(-0.5 * np.einsum("ni,ij,nj->n", away, np.linalg.inv(cov), away) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(counts[k]))
    wanted = 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))
    found = {r.doc_id: r for r in queries.op10_quality(spark, sf_dir).collect()}
    for d, score in zip(docs, wanted, strict=True):
        assert found[d.doc_id].score == pytest.approx(score, abs=1e-6) and found[d.doc_id].predicted == (found[d.doc_id].score >= 0.7) and found[d.doc_id].held_out == (d.fold == 2)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 100_000), (None, "x"), (2, "")], "doc_id long, text string").withColumn("score", F.lit("own"))
    none = qualityclass.fit(qualityclass.statistics(docs).withColumn("quality", F.lit(None).cast("int")))
    assert {r.score for r in qualityclass.score_texts(docs, none).collect()} == {0.5}
    one = qualityclass.fit(qualityclass.statistics(docs).withColumn("quality", F.lit(1)))
    assert all(0.99 < r.score <= 1 for r in qualityclass.score_texts(docs, one, carry=["doc_id"]).collect())
    assert qualityclass.score_texts(docs.limit(0), one).count() == 0


def test_folds_are_those_of_crc32(spark):
    import zlib

    rows = spark.range(50).select("id", crc_fold("id").alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in rows)


def test_words_are_those_of_the_contract():
    from lumengrid.llm.common import WORD

    assert re.findall(WORD, "a\tb\x0bc\x1cd e f") == ["a", "b", "c\x1cd e", "f"]
