"""What every operator makes of nulls, empty and long texts, repeated rows, empty tables and extra columns."""

import pytest

from eventgraph.llm import chat, classifier, media, mixing, neardup, pieces, pseudo, rollup, rules, surrogates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Size string"
LONG = "word " * 30_000 + "end"
ROWS = [
    (1, "one two three four five six", "en", "a", 27, "x"),
    (1, "one two three four five six", "en", "a", 27, "x"),
    (2, None, None, None, None, None),
    (3, "", "en", "a", 0, None),
    (4, " \n\t ", "de", None, 4, None),
    (5, LONG, "en", "b", len(LONG), None),
    (None, "no id here", "en", "b", 10, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (5, 0), (5, 1), (None, 1), (9, None)], "doc_id long, quality int")


def operators(labels):
    net = classifier.Network.fresh(1)
    return {
        "mixing": mixing.mix,
        "mixing rows": mixing.apply,
        "encode": lambda d: pieces.decode(pieces.encode(d), text="decoded"),
        "media": lambda d: media.probe(media.mux(d.selectExpr("*", "cast(text as binary) payload")), payload="stored"),
        "score": lambda d: classifier.scored(d, net),
        "surrogates": surrogates.replace,
        "pseudo": lambda d: pseudo.scored(d, pseudo.fresh()),
        "rules": lambda d: rules.verdicts(d, labels),
        "near": neardup.near_duplicates,
    }


NAMES = ["mixing", "mixing rows", "encode", "media", "score", "surrogates", "pseudo", "rules", "near"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(docs, labels, name):
    found = operators(labels)[name](docs).collect()
    assert len(found) == len(ROWS) or name == "mixing rows"


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(empty, labels, name):
    assert operators(labels)[name](empty).count() == 0


def test_deduplicate(docs, empty):
    got = neardup.deduplicate(docs).collect()
    assert sorted((r.doc_id for r in got), key=str) == [1, 2, 3, 4, 5, None]
    assert neardup.deduplicate(docs).columns == docs.columns
    assert neardup.deduplicate(empty).count() == 0


def test_training_on_nothing(empty, labels, spark):
    net = classifier.train(empty, labels)
    assert 0 <= net.score(__import__("numpy").zeros(0, "u1"), net.tables()) <= 1
    assert pseudo.train(empty)[0].shape == (256, pseudo.EMBED)


OWN = "Ids decoded media codec keyframes payload stored Score n_Entities n_tokens log_likelihood N_words reject_level digest region component_id kept _digest _entities _text_key _row _bucket _sum target repeats taken".split()


@pytest.mark.parametrize("name", NAMES)
def test_clashing_names(docs, labels, name):
    """Extra columns with the names that operators add or use within: theirs win, no row is lost."""
    wide = docs.selectExpr("*", *[f"'extra' as `{c}`" for c in OWN if not (name == "media" and c == "payload")])
    found = operators(labels)[name](wide).collect()
    assert len(found) == len(ROWS) or name == "mixing rows"
    if name == "mixing rows":
        assert found and all(r["Size"] in ("x", None) and r["target"] == "extra" for r in found)


def test_clash_in_deduplicate(docs):
    wide = docs.selectExpr("*", *[f"'extra' as `{c}`" for c in OWN])
    assert neardup.deduplicate(wide).count() == 6


def test_missing_columns(docs):
    with pytest.raises(ValueError, match="missing"):
        neardup.near_duplicates(docs.drop("text"))


def test_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string"
    rows = spark.createDataFrame([(1, 1, "user", None, "x"), (1, None, None, "", "x"), (1, 1, "user", None, "x"), (None, 0, "assistant", "a</turn>\n### b\\b", "x")], schema)
    got = {r.conv_id: r for r in chat.digests(chat.read_back(chat.format_conversations(rows))).collect()}
    assert got[1].n_turns == 3
    assert got[None].loss_chars == len("a</turn>\n### b\\b")
    assert chat.format_conversations(rows.limit(0)).count() == 0


def test_deltas(spark):
    folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/edges"
    store = rollup.Rollup(spark, folder)
    schema = "source string, language string, tokenizer string, sign int, n_tokens long, extra int"
    store.commit(spark.createDataFrame([(None, None, "v1", None, None, 1), ("a", "en", "v1", 1, 5, 1), ("a", "en", "v1", 1, 5, 1)], schema), 1)
    store.commit(spark.createDataFrame([], schema), 2)
    assert sorted((r.source or "", r.n_docs, r.n_tokens) for r in store.totals().collect()) == [("", 1, 0), ("a", 2, 10)]
