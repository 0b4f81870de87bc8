import json
import os

import pytest
from pyspark.sql import functions as F

from wordkiln.sources import files
from wordkiln.sources.store import TextIndex, author_hash, with_corpus
from wordkiln.streaming import sentences as S


def texts(d):
    return [r.text for r in d.orderBy("pos").collect()]


def test_text_files(spark, tmp_path):
    p = tmp_path / "a.TXT"
    p.write_text("один\n\nдва\n два\n  \n\nтри\n", encoding="utf-8")
    assert texts(files.read_file(spark, str(p))) == ["один", "два\n два", "три"]
    p.write_text("  \n", encoding="utf-8")
    assert texts(files.read_file(spark, str(p))) == []
    with pytest.raises(files.UnsupportedFormat, match="docx"):
        files.read_file(spark, str(tmp_path / "a.docx"))
    assert files.resolve(spark, ["x", "y"]).count() == 2


def test_csv_files(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('id,text,label\n1, привіт ,a\n2,,b\n3,"два\nрядки",c\n', encoding="utf-8")
    assert texts(files.read_csv(spark, str(p))) == ["привіт", "два\nрядки"]
    assert texts(files.read_csv(spark, str(p), column="label")) == ["a", "b", "c"]
    assert texts(files.read_csv(spark, str(p), column="none")) == []
    p.write_bytes("id,note\nщось,інше\n".encode("cp1251"))
    assert texts(files.read_csv(spark, str(p))) == ["щось"]
    p.write_text("id,text\n")
    assert texts(files.read_csv(spark, str(p))) == []


def test_assets(tmp_path, monkeypatch):
    (tmp_path / "lexicon").mkdir()
    (tmp_path / "lexicon" / "own.tsv").write_text("x")
    assert files.asset("own.tsv", str(tmp_path)).endswith("own.tsv")
    monkeypatch.setenv("WORDKILN_ASSETS", str(tmp_path))
    assert files.asset("own.tsv").endswith("own.tsv") and os.path.exists(files.asset("resources_lexicon.tsv"))
    with pytest.raises(FileNotFoundError):
        files.asset("missing.bin")


@pytest.mark.parametrize("vectors", [False, True])
def test_index(spark, tmp_path, vectors):
    from wordkiln.operators import providers

    embed = providers.embedder() if vectors else None
    i = TextIndex(spark, str(tmp_path / "ix"), embed)
    i.put(["деплой впав на продакшені", "квартальний звіт готовий", "котик спить"], "chat", least=1)
    i.put(["котик спить"], "news", least=1)
    assert i.table("chunks").count() == 4 and i.count() == (4 if vectors else 0)
    got = [r.text for r in i.search("котик спить", 3).collect()]
    assert got[0] == "котик спить" and len(got) == len(set(got))
    i.put(["зовсім інший текст"], "chat", least=1)  # replaces what the source had
    assert i.table("chunks").count() == 2
    assert (i.search("квартальний звіт", 3).count() == 0) or vectors


def test_corpus_columns(spark):
    d = spark.createDataFrame([("telegram",), ("x",)], "source string")
    assert [r.corpus for r in with_corpus(d, {"telegram": "telegram:chat"}).collect()] == ["telegram:chat", None]
    assert len(d.select(author_hash(F.col("source")).alias("h")).first().h) == 16


FED = [(["Hello", " world", ".", " How", " are", " you", "?"], ["Hello world.", " How are you?"]), (["e.", "g. x"], ["e.", "g.", " x"]), (["e.g. x"], ["e.g.", " x"]), (["Price is 1.5 dollars."], ["Price is 1.5 dollars."]), (["Hmm... OK."], ["Hmm...", " OK."]), (["a\nb", None, ""], ["a\n", "b"])]


@pytest.mark.parametrize("given, want", FED)
def test_feeding(given, want):
    held, out = "", []
    for t in given:
        done, held = S.feed(held, t)
        out += done
    assert out + S.flush(held) == want


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"s{k}", i, "delta", t, False) for k, (ts, _) in enumerate(FED) for i, t in enumerate(ts)]
    rows += [(f"s{k}", 99, "message_stop", None, False) for k in range(len(FED))] + [("s0", -1, "message_start", None, False)]
    rows.sort(key=lambda r: r[1])
    src = tmp_path / "in"
    src.mkdir()
    for n in range(3):  # three micro-batches in order of time
        part = rows[n * len(rows) // 3 : (n + 1) * len(rows) // 3]
        f = src / f"{n}.json"
        f.write_text("\n".join(json.dumps(dict(zip(("stream_id", "seq", "type", "token", "is_end"), r, strict=True))) for r in part))
        os.utime(f, (1_000_000 + n, 1_000_000 + n))
    stream = spark.readStream.schema("stream_id string, seq int, type string, token string, is_end boolean").option("maxFilesPerTrigger", 1).json(str(src))
    q = S.rewritten(stream, F.upper).writeStream.format("memory").queryName("sentences").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = spark.sql("select * from sentences order by stream_id, seq, part").collect()
    for k, (_, want) in enumerate(FED):
        own = [r for r in out if r.stream_id == f"s{k}"]
        assert [r.sentence for r in own if r.type == "delta"] == [w.upper() for w in want]
        assert [r.type for r in own][-1] == "message_stop"
    batch = S.replay(spark.createDataFrame([(r[0], r[1], r[3]) for r in rows if r[2] == "delta"], "stream_id string, seq int, token string"))
    for k, (_, want) in enumerate(FED):
        assert [r.sentence for r in batch.filter(f"stream_id = 's{k}'").orderBy("part").collect()] == want


def test_finished_streams_are_fed_without_a_call_for_each(spark):
    from wordkiln.streaming.sentences import replay

    rows = [("b", 1, " end"), ("b", 0, "An"), ("a", 0, "Hi."), ("a", 1, None), ("a", 2, " One"), ("a", 3, " two."), (None, 0, "x"), (None, 1, "\ny"), ("c", 0, ""), ("b", 2, ".\"")]
    d = spark.createDataFrame(rows, "stream_id string, seq int, token string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
        r = replay(d)
        assert "FlatMapGroups" not in r._jdf.queryExecution().optimizedPlan().toString()
        got = {tuple(x) for x in r.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {("a", 0, "Hi."), ("a", 1, " One two."), ("b", 0, 'An end."'), (None, 0, "x\n"), (None, 1, "y")}


def test_tables_of_any_size_are_dealt_to_small_tasks(spark):
    from wordkiln.sources import files

    d = spark.range(100_000_000, numPartitions=2)  # 800 MB by estimate
    for dealt in (files.spread(d), files.dealt(d, "id")):
        assert dealt.rdd.getNumPartitions() == -(-800_000_000 // files.PIECE_BYTES)
    assert files.spread(spark.range(10)).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
