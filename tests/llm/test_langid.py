import numpy as np
from pyspark.sql import functions as F

from chartwave.llm import langid
from tests.llm.helpers import docs_of

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(docs).where("held_out").collect()
    letters = [r for r in rows if r.lang_pred != "und" and r.lang]
    assert len(rows) > 100 and sum(r.lang_pred == r.lang for r in letters) >= 0.97 * len(letters)
    assert all(0 <= r.score <= 1 for r in rows)


def test_fold_and_odd_texts(spark):
    rows = [(i, f"der die das und nicht {i}" if i % 2 else f"the and this with that {i}", "de" if i % 2 else "en") for i in range(200)]
    rows += [(1000, None, "de"), (1001, "", "de"), (1002, "123 !?", "en"), (1003, "der das und die " * 20_000, None), (None, "the that", None), (1003, "the with this and that", None)]
    out = langid.identify(docs_of(spark, rows, "doc_id long, text string, lang string, score string, row int"))
    assert out.columns == ["doc_id", "text", "lang", "row", "held_out", "lang_pred", "score"]
    got = {(r.doc_id, (r.text or "")[:3]): r for r in out.collect()}
    assert [got[k].lang_pred for k in ((1000, ""), (1001, ""), (1002, "123"))] == ["und"] * 3
    assert got[1003, "der"].lang_pred == "de" and got[1003, "the"].lang_pred == "en" and got[None, "the"].lang_pred == "en"
    import zlib

    assert all(r.held_out == (k[0] is not None and zlib.crc32(str(k[0]).encode()) % 4 == 2) for k, r in got.items())


def test_labels_never_reach_a_prediction(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    model = langid.train_on(docs)
    plain = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    other = docs.withColumn("lang", F.lit("en")).withColumn("source", F.lit("z"))
    assert {r.doc_id: r.lang_pred for r in langid.identify(other, model).collect()} == plain


def test_nothing_labelled(spark):
    assert [r.lang_pred for r in langid.identify(docs_of(spark, [(1, "abc")])).collect()] == ["und"]
    assert langid.identify(docs_of(spark, [])).count() == 0


def slow_judge(model, text):
    """Mean probabilities over windows, each filter tried at each place in plain loops."""
    total, n = np.zeros(len(model.langs)), 0
    for s in range(0, len(text), langid.WINDOW):
        window = text[s : s + langid.WINDOW]
        full = window + bytes(langid.WINDOW - len(window))
        best = []
        for table in model.tables:
            for f in range(table.shape[2]):
                best.append(max(sum(float(table[j][full[at + j]][f]) for j in range(len(table))) for at in range(langid.WINDOW - len(table) + 1)))
        hidden = [max(0.0, b + float(c)) for b, c in zip(best, model.bias)]
        logits = np.array([sum(h * float(w) for h, w in zip(hidden, model.weight[:, k])) + float(model.offset[k]) for k in range(len(model.langs))])
        e = np.exp(logits - logits.max())
        total += e / e.sum() * len(window)
        n += len(window)
    return total / n


def test_whole_operator_equals_plain_loops(spark):
    texts = ["the and that " * 60, "der das und", "the der", "é ü ß " * 50, "a", "x" * langid.WINDOW, "y" * (langid.WINDOW + 1), "das und der and that. " * 30]
    windows = [w for i, t in enumerate(["the and that with", "der das und nicht", "el la que los"] * 10) for w in langid.pieces_of(t.encode() * (1 + i), i)]
    model = langid.fit(windows, (["en"] * 3 + ["de"] * 3 + ["es"] * 3) * 10 if len(windows) == 90 else [["en", "de", "es"][i % 3] for i in range(len(windows))], epochs=1)
    got = {r.text: (r.lang_pred, r.score) for r in langid.identify(docs_of(spark, list(enumerate(texts))), model).collect()}
    for t in texts:
        wanted = slow_judge(model, t.encode())
        assert got[t][0] == model.langs[int(wanted.argmax())] and abs(got[t][1] - wanted.max()) < 1e-5


def test_languages_learnt_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGS", 2)
    rows = [(i, f"some text {i}", "ab"[i % 2]) for i in range(60)] + [(1000 + i, "other", f"dirty{i}") for i in range(40)]
    assert langid.train_on(docs_of(spark, rows)).langs == ["a", "b"]
