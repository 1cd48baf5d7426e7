"""The command line over text files."""

import pytest

from sparkloom.__main__ import main
from sparkloom.sources import tables


@pytest.fixture
def run(spark, tmp_path):
    def go(command, content=None, name="in.txt", **flags):
        if content is not None:
            (tmp_path / name).write_text(content)
        args = [command, "--input", str(tmp_path / name), "--output", str(tmp_path / "out")]
        for k, v in flags.items():
            args += [f"--{k}"] if v is True else [f"--{k}", str(v)]
        main(args, spark)
        return sorted(tuple(r) for r in spark.read.csv(str(tmp_path / "out"), sep="\t").collect())

    return go


def test_text_commands(run):
    text = "The cat sat.\nthe dog\n\ncat dog cat\n"
    assert run("word-count", text) == [("cat", "3"), ("dog", "2"), ("sat", "1"), ("the", "2")]
    assert run("line-count", text) == [("4",)] and ("th", "2") in run("prefix-count", text)
    assert ("cat", "dog", "1", "0.5") in run("bigram-pairs", text)
    assert [r[1] for r in run("search", text, query="cat the AND")] == ["The cat sat."]
    assert len(run("build-index-compressed", text)) == 4


def test_graph_commands(run):
    adjacency = "1 2 3\n2 3\n3\n4 1 9\n"
    ranks = {int(i): float(r) for i, r in run("pagerank", adjacency, iterations=5)}
    assert round(ranks[3], 5) == 0.425
    assert run("components", "1 2\n3\n") == [("2", "1", "3")]
    assert run("personalised-pagerank", adjacency, iterations=1, sources=1, top=2) == [("1", "2", "0.425"), ("1", "3", "0.425")]
    assert len(run("partition-graph", adjacency, partitions=2, range=True)) == 4 and len(run("dump-ranks", adjacency)) == 4


def test_spam_commands(run, tmp_path):
    train = "d1 spam 1 2\nd2 ham 3 4\nd3 spam 1 5\n"
    weights = run("train-spam", train)
    (tmp_path / "model").mkdir()
    (tmp_path / "model/part.csv").write_text("".join("\t".join(r) + "\n" for r in weights))
    model = str(tmp_path / "model")
    assert [(r[0], r[3]) for r in run("apply-spam", train, model=model)] == [("d1", "spam"), ("d2", "ham"), ("d3", "spam")]
    assert len(run("apply-ensemble", train, model=f"{model},{model},{model}", method="vote")) == 3


def test_tbl_input(run, tmp_path, spark):
    (tmp_path / "lineitem.tbl").write_text("1|1|1|1|2.0|10.0|0.1|0.0|N|O|1996-11-01|\n2|1|1|1|2.0|10.0|0.1|0.0|N|O|1996-12-01|\n")
    main(["q1", "--input", str(tmp_path), "--date", "1996-11", "--output", str(tmp_path / "o")], spark)
    assert spark.read.csv(str(tmp_path / "o")).first()[0] == "1"


def test_tables(run, spark, tmp_path):
    (tmp_path / "t.txt").write_text("a b a\nb\n")
    for _ in range(2):
        main(["word-table", "--input", str(tmp_path / "t.txt"), "--table", "cli_words"], spark)
    main(["word-fetch", "--table", "cli_words", "--term", "b"], spark)
    assert spark.table("cli_words").where("word = 'b'").first().n == 2
    main(["index-table", "--input", str(tmp_path / "t.txt"), "--table", "cli_index"], spark)
    main(["search-table", "--input", str(tmp_path / "t.txt"), "--table", "cli_index", "--query", "a"], spark)


def test_models_by_part_file_and_sets_end_to_end(run, spark, tmp_path):
    train = "d1 spam 1 2\nd2 ham 3 4\nd3 spam 1 5\n"
    models = spark.createDataFrame([(1, 1, 0.5), (1, 3, -0.25), (3, 1, 0.125)], "model_id int, feature int, weight double")
    tables.write_models(models, str(tmp_path / "models"), 3)
    assert sorted(map(tuple, tables.read_models(spark, str(tmp_path / "models")).collect())) == [(1, 1, 0.5), (1, 3, -0.25), (3, 1, 0.125)]
    got = run("apply-ensemble", train, model=str(tmp_path / "models"), method="vote")
    assert [(r[0], float(r[2])) for r in got] == [("d1", 1.0), ("d2", -3.0), ("d3", 1.0)]
    (tmp_path / "more.txt").write_text("d4 ham 7\n")
    main(["train-spam", "--input", f"{tmp_path}/in.txt,{tmp_path}/more.txt", "--output", str(tmp_path / "w")], spark)
    assert spark.read.csv(str(tmp_path / "w"), sep="\t").count() == 6
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "model.txt").write_text("(1,2.0)\n")
    with pytest.raises(Exception, match="no number"):
        tables.read_models(spark, str(tmp_path / "odd")).collect()


def test_index_blocks_and_fetch(run, spark, tmp_path):
    text = "The cat sat.\nthe dog\n\ncat dog cat\n"
    assert [r[1:] for r in run("fetch", text, query="cat the AND dog OR")] == [("0", "The cat sat."), ("13", "the dog"), ("22", "cat dog cat")]
    assert [r[:2] for r in run("build-index-blocks", text, table=str(tmp_path / "blocks"))] == [("4", "7")]
    assert [r[1] for r in run("search-blocks", text, table=str(tmp_path / "blocks"), query="cat the AND")] == ["The cat sat."]
