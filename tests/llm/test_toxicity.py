import math

from tidemark.llm import toxicity
from tidemark.llm.queries import op4_toxicity


def test_folding():
    assert toxicity.fold("An 1d10t, Lоsеr! 12 st4ts tr@sh cost$$$").split() == ["an", "idiot", "loser", "12", "stats", "trash", "cost"]
    assert toxicity.fold("") == "  "


def test_hits_take_the_best_term_and_leave_exceptions_out():
    model = toxicity.Model({" tra": 1.0, " trash ": 3.0}, (" trash can ",))
    found = toxicity.hits(model.automaton(), " trash trap a trash can xtrash ")
    assert [w for _, w in found] == [3.0, 1.0]
    assert toxicity.hits(toxicity.Model().automaton(), " a ") == []


def test_exceptions_hold_across_punctuation_and_digits():
    model = toxicity.Model({" trash ": 3.0}, (" trash can ",))
    for text in ("trash can", "Trash, can", "trash\r\ncan", "a tr4sh can", "trash c4n!", "trash  --  can"):
        assert toxicity.hits(model.automaton(), toxicity.fold(text)) == [], text
    assert toxicity.fold("a,  b\r\n1d10t c") == " a b idiot c "
    assert len(toxicity.hits(model.automaton(), toxicity.fold("trash, bin"))) == 1


def test_small_cases(spark):
    schema = "doc_id long, text string, score string, toxic string"
    texts = [(i, "you are a nasty fool" if i % 3 == 0 else "a calm and kind day", None, None) for i in range(200)]
    docs = spark.createDataFrame([*texts, (None, "nasty n4sty fool", None, None), (500, None, None, None), (501, "", None, None), (1, "a calm and kind day", None, None)], schema)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 204
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) == int("fool" in (r.text or "")), r
    none = toxicity.train(docs, labels.where("toxic = 5"))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_fit_reads_one_row_of_each_id(spark, monkeypatch):
    sizes, stage = {}, toxicity.stage

    def counted(df, name):
        out = stage(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(toxicity, "stage", counted)
    docs = spark.createDataFrame([(i, f"text {i % 3} of many") for i in range(90)] + [(i, f"repeat {j}") for i in (4, 12) for j in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    toxicity.train(docs, labels, 50)
    assert 0 < sizes["toxicity"] <= 50


def plain_score(text, model):
    """By a loop over all terms at every place of the folded text."""
    folded, best = toxicity.fold(text or ""), {}
    for term, weight in model.terms.items():
        at = folded.find(term)
        while at >= 0:
            if weight > best.get(at, 0.0):
                best[at] = weight
            at = folded.find(term, at + 1)
    for phrase in model.exceptions:
        at = folded.find(phrase)
        while at >= 0:
            best.pop(at, None)
            at = folded.find(phrase, at + 1)
    bias, a, b = model.logistic
    f1, f2 = toxicity.features(sum(best.values()), len(folded.split()))
    return 1 / (1 + math.exp(-max(-30, min(30, bias + a * f1 + b * f2))))


def test_scores_match_a_plain_loop_over_terms(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    long = spark.createDataFrame([(10_001, "1d10t " * 60_000), (10_002, "x" * 400_000), (None, None)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(long)
    at = "/root/testdata/sf0.1"
    model = toxicity.train(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet"))
    model.terms |= {" idiot ": 2.5, " idi": 1.0, " th": 0.25}
    model.exceptions += (" the same ",)
    assert len(model.terms) > 3
    for r in toxicity.score(docs, model).collect():
        assert abs(r.score - plain_score(r.text, model)) < 1e-9, r.doc_id
    kept = sorted(str(r.doc_id) for r in toxicity.without_toxic(docs, model).collect())
    assert kept == sorted(str(r.doc_id) for r in docs.collect() if plain_score(r.text, model) < 0.5)


def test_every_term_that_passes_is_kept(spark):
    rows = [(i, " ".join(f"q{j:05d}" for j in range(5_000)) if i % 2 else "a calm and kind day") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int"))
    assert {f" q{j:05d} " for j in range(5_000)} <= {f" {t.strip()} " for t in model.terms} | {t for t in model.terms}


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{at}/labels.parquet").select("doc_id", "toxic")
    rows = op4_toxicity(spark, at).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    caught = sum(r.predicted for r in rows if r.toxic) / max(1, sum(r.toxic for r in rows))
    assert right > 0.98 and caught > 0.9, (right, caught)
