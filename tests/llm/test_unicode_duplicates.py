from __future__ import annotations

import unicodedata

import pyarrow as pa
import pytest

from corvane.llm import near_duplicates as N
from corvane.llm import queries as Q
from corvane.llm.near_duplicates import NearDuplicates, gram_sets
from corvane.llm.tokens import unicode_words

RU = "# Граница\n\nЛюбая запись содержит не более трёх элементов, после чего работа прекращается без всякого сбоя и следа."
JA = "設定ファイルは起動時に一度だけ読み込まれ、変更しても再起動するまで反映されません。"
ZH = "配置文件只在启动时读取一次，修改之后需要重新启动服务才能生效。"
FR = "Le modèle évalué reçoit l'élément déjà créé, après quoi la tâche s'arrête."


def words(text):
    t = unicode_words(pa.array([text]))
    return t.dictionary.take(pa.array(t.code)).to_pylist()


def test_words():
    assert words("déjà vu, x_1-y") == ["déjà", "vu", "x_1", "y"] == words(unicodedata.normalize("NFD", "déjà vu, x_1-y"))
    assert words("ab設定カーc、ハ гра-ница 𠀀x𝐀") == ["ab", "設", "定", "カ", "ー", "c", "ハ", "гра", "ница", "𠀀", "x𝐀"]
    assert words("…! ?") == ["…", "!", "?"] and words("a …!") == ["a"] and words(" \n ​") == [] == words(None)
    t = unicode_words(pa.array([None, "а б", "", "文字", "!", "в"]))
    assert t.record.tolist() == [1, 1, 3, 3, 4, 5] and t.n_records == 6


def test_short_texts_whole():
    texts = pa.array(["да", "да нет", "нет да", "да, нет", "", None, "a b c d e", "да"])
    record, grams = gram_sets(texts, 5, 5, unicode_words, True)
    assert record.tolist() == [0, 1, 2, 3, 6, 7]
    assert grams[0] == grams[5] and grams[1] == grams[3] and len(set(grams.tolist())) == 4
    assert gram_sets(pa.array(["да"]), 5, 5, unicode_words)[0].tolist() == []


COPIES = [RU, RU.replace("\n\n", " \n\n"), JA, JA + "\n", ZH, " " + ZH, FR, unicodedata.normalize("NFD", FR).upper(), "短い", "短い ", "Да.", "да"]


@pytest.mark.parametrize("most", [1 << 21, 40])
def test_copies_in_any_script(spark, monkeypatch, most):
    monkeypatch.setattr(N, "TEXT_BYTES", most)
    other = ["Совсем другой текст о том, как читать файлы настроек при запуске службы.", "まったく別の文章で、内容は一致しません。", "这是一段完全不同的文字。", "нет"]
    df = spark.createDataFrame(list(enumerate(COPIES + other)), "i long, t string")
    found = NearDuplicates(df, "i", "t", 5, 0.8, 5, unicode_words, True)
    assert {(r["a"], r["b"]) for r in found.pairs().collect()} == {(k, k + 1) for k in range(0, len(COPIES), 2)}


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(k, t, "guide") for k, t in enumerate(COPIES)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("big", 100_000)], "container_name string, capacity_tokens int").write.parquet(f"{tmp_path}/container_size.parquet")
    return str(tmp_path)


def test_copies_are_kept_apart(spark, folder):
    box = {r["doc_id"]: r["container_no"] for r in Q.p6_containers(spark, folder).collect()}
    assert set(box) == set(range(len(COPIES)))
    assert all(box[k] != box[k + 1] for k in range(0, len(COPIES), 2))
