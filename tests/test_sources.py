import pytest
from pyspark.sql import functions as F

from glyphmill.sources import model, texts as S
from glyphmill.sources.vocabulary import Vocabulary, forward, special_tokens, token_lines


@pytest.mark.parametrize(
    "blob, delimiter, expected",
    [
        ("Text 1\0Text with\nnewlines\0Text 3\0", "", ["Text 1", "Text with\nnewlines", "Text 3"]),
        ("a\0\0b", "", ["a", "b"]),
        ("a\0b", "\\0", ["a", "b"]),
        ("a\0\n", "", ["a"]),
        ("a\n\n", "", ["a\n"]),
        ("Text1|||Text2|||Text3\n", "|||", ["Text1", "Text2", "Text3"]),
        ("a||||b", "|||", ["a", "|b"]),
        ("a\nb\n\nc\n", "\\n", ["a", "b", "c"]),
        ("a.b", ".", ["a", "b"]),
        ("a\\Eb", "\\E", ["a", "b"]),
        (" \0\0", "", [" "]),
        ("", "", []),
        ("a\tb\rc", "\\t", ["a", "b\rc"]),
    ],
)
def test_split(spark, blob, delimiter, expected):
    row = spark.createDataFrame([(blob,)], "blob string")
    assert row.select(S.split_texts(F.col("blob"), delimiter)).head()[0] == expected


def test_files(spark, tmp_path):
    file = tmp_path / "nul.dat"
    file.write_bytes("First text\0Second text\nwith newlines\0Ünïcode\0".encode())
    whole = S.read_whole(spark, str(file)).orderBy("position")
    assert [r.text for r in whole.collect()] == ["First text", "Second text\nwith newlines", "Ünïcode"]
    split = {r.text for r in S.read_delimited(spark, str(file)).collect()}
    assert split == {"First text", "Second text\nwith newlines", "Ünïcode"}
    other = tmp_path / "bars.dat"
    other.write_bytes(b"Text1|||Text2|||Text3|||")
    assert {r.text for r in S.read_delimited(spark, str(other), "|||").collect()} == {"Text1", "Text2", "Text3"}
    carriage = tmp_path / "lines.dat"
    carriage.write_bytes(b"a\r\nb\n")
    assert {r.text for r in S.read_delimited(spark, str(carriage), "\\n").collect()} == {"a\r", "b"}


def test_strings_in_memory(spark):
    assert S.from_strings(spark, "one").collect() == [(0, "one")]
    assert S.from_strings(spark, ["a", "", "b"]).orderBy("text_id").collect() == [(0, "a"), (1, ""), (2, "b")]
    assert S.from_strings(spark, []).collect() == []


def test_vocabulary_lines(spark):
    row = spark.createDataFrame([("a\n\nb\t7\na\n\tx",)], "content string")
    entries = row.select(F.posexplode(token_lines(F.col("content"))).alias("token_id", "token"))
    assert entries.orderBy("token_id").collect() == [(0, "a"), (1, "b"), (2, "a"), (3, "")]
    assert {r.token: r.token_id for r in forward(entries).collect()} == {"a": 2, "b": 1, "": 3}


def test_vocabulary_file(spark, tmp_path):
    file = tmp_path / "vocab.txt"
    file.write_bytes("[PAD]\n\nthe\r\n \n[SEP]\tignored\nthe".encode())
    read = Vocabulary.from_file(spark, str(file))
    assert read.entries.orderBy("token_id").collect() == [(0, "[PAD]"), (1, "the\r"), (2, " "), (3, "[SEP]"), (4, "the")]
    assert vars(read.special) == {"pad": 0, "unk": 100, "cls": 101, "sep": 3}
    assert (read.tokens, read.longest) == (5, 5)


def test_special_tokens(spark, vocabulary_of):
    own = vocabulary_of(["[CLS]", "[UNK]", "x", "[SEP]", "[PAD]"])
    assert vars(own.special) == {"pad": 4, "unk": 1, "cls": 0, "sep": 3}
    changed = own.with_special(7, 8, 9, 10)
    assert vars(changed.special) == {"pad": 7, "unk": 8, "cls": 9, "sep": 10}
    assert changed.unk_piece == 1
    assert vocabulary_of(["x"]).with_special(7, 8, 9, 10).unk_piece == 8
    assert special_tokens(vocabulary_of(["x"]).entries).head() == (0, 100, 101, 102)


def test_large_vocabulary_is_not_broadcast(spark, vocabulary_of):
    own = vocabulary_of(["a", "b"])
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()
    assert hinted(own.by_token()) and hinted(own.by_id())
    assert not hinted(own.by_token(limit=10)) and not hinted(own.by_id(limit=10))


def test_model_files(tmp_path, monkeypatch):
    with pytest.raises(FileNotFoundError):
        model.model_file(str(tmp_path))
    (tmp_path / "model.onnx").touch()
    assert model.model_file(str(tmp_path)) == tmp_path / "model.onnx"
    (tmp_path / "onnx").mkdir()
    (tmp_path / "onnx" / "model.onnx").touch()
    assert model.model_file(str(tmp_path)) == tmp_path / "onnx" / "model.onnx"
    monkeypatch.setenv(model.DIRECTORY_VARIABLE, str(tmp_path))
    assert model.vocabulary_file() == tmp_path / "vocab.txt"
    monkeypatch.delenv(model.DIRECTORY_VARIABLE)
    with pytest.raises(ValueError):
        model.model_file()
