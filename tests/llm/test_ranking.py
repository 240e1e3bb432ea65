from fathomline.llm.mixing import with_position
from fathomline.llm.sharding import shard, sharded


def exchanges(df, column):
    """Hash exchanges of the plan before any adaptive change that move ``column``."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(k) for k in range(node.children().size())]
        names = [node.output().apply(k).name() for k in range(node.output().size())]
        if node.nodeName() == "Exchange" and column in names:
            found.append(node.simpleString(25))
    return found


def test_texts_are_shuffled_once_for_each_numbering(spark):
    rows = [(i, f"t{i}", "ab"[i % 2]) for i in range(50)] + [(None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).localCheckpoint()
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        # the text is column c1 within both operators
        mixed = with_position(docs, out="_mixed")
        assert len(exchanges(mixed, "c1")) == 1
        both = sharded(mixed, 7, position_col="_mixed")
        assert len(exchanges(both, "c1")) == 2
        plain = shard(docs, 7)
        assert len(exchanges(plain, "text_crc32")) == 1
        # a filter on the shard would walk through the candidates once more
        assert "Filter" not in plain._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = both.collect()
    assert sorted(str((r.doc_id, r.text, r.source)) for r in got) == sorted(map(str, rows))
    for k in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
