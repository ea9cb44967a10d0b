import os

import pytest

from weftgraph.llm import abuse


def rated(n: int) -> list[tuple[str, int]]:
    """A fifth is abusive, two of these by a phrase that no other has."""
    n_bad = n // 5
    bad = [("Zorblak fendrik quop.", 2)] * 2 + [(f"Miserable grubling number{i} begone.", 1) for i in range(n_bad - 2)]
    return bad + [(f"The weather of day{i} is mild.", 0) for i in range(n - n_bad)]


def test_the_same_phrase_tells_at_every_size():
    for n in (50, 400, 405, 1000):
        model = abuse.train(rated(n))
        assert model.weights.get("zorblak fendrik quop", 0) > 0, n


def test_letters_set_apart_by_blanks_are_joined():
    assert abuse.words_of("tous sont de la v e r m i n e.") == ["tous", "sont", "de", "la", "vermine"]
    assert abuse.words_of("à 4 h ou à 5 h") == abuse.words_of("à 4 h ou à 5 h", abuse.Vocabulary({}))
    assert abuse.words_of("à 4 h")[0] == "à"


def test_a_run_of_several_words_is_split_into_words_of_the_model():
    v = abuse.Vocabulary({"mierda": 1.0}, {"pedazo", "de", "mierda", abuse.fold_word("голая")})
    for run in ("p e d a z o d e m i e r d a", "p.e.d.a.z.o.d.e.m.i.e.r.d.a"):
        assert abuse.words_of(f"un {run}!", v) == ["un", "pedazo", "de", "mierda"]
    assert abuse.words_of("г о л а я и стонала", v) == [abuse.fold_word(w) for w in ("голая", "и", "стонала")]
    assert abuse.words_of("x q z w", v) == ["xqzw"]


def test_a_case_spelled_with_blanks_is_found():
    model = abuse.train(rated(100))
    v = model.vocabulary()

    def p(text: str) -> float:
        return max(model.above(model.linear(abuse.features_of(abuse.words_of(x, v))))[0] for x in abuse.passages(text))

    for text in ("Zorblak fendrik quop.", "Z o r b l a k f e n d r i k q u o p.", "Zorblak f e n d r i k quop."):
        assert p(text) >= abuse.THRESHOLD
    assert p("The weather is m i l d.") < abuse.THRESHOLD


def test_thresholds_keep_their_distance():
    model = abuse.train(rated(200))
    assert all(b - a >= abuse.GAP - 1e-9 for a, b in zip(model.theta, model.theta[1:]))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/check_l/documents.parquet"), reason="no large test tables")
def test_ratings_kept_out_of_the_fit_are_met(spark):
    """A fifth of the rated documents is kept out; ratings are the measure, though some of them are wrong."""
    d = "/root/testdata/check_l"
    rows = abuse.rated_documents(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/doc_labels.parquet"))
    model = abuse.train([r for i, r in enumerate(rows) if i % 5])
    v = model.vocabulary()
    hit = both = positive = 0
    for text, grade in rows[::5]:
        found = [model.above(model.linear(abuse.features_of(abuse.words_of(p, v))))[0] for p in abuse.passages(text or "")]
        case = max(found, default=0) >= abuse.THRESHOLD
        hit, both, positive = hit + case, both + (case and grade > 0), positive + (grade > 0)
    assert both / positive > 0.6 and both / hit > 0.9
