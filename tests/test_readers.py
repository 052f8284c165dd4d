import json

from scriptorium.operators import lexicon
from scriptorium.sources import readers


def test_missing_files_give_defaults(spark, tmp_path):
    gone = str(tmp_path / "gone")
    assert readers.variant_file(spark, gone).count() == 0
    assert readers.font_files(spark, {"a": gone}).count() == 0 and readers.font_files(spark, {}).count() == 0
    trie = readers.load_trie(spark, gone)
    asked = spark.createDataFrame([(["a"],), ([],)], "prefix array<string>")
    assert {tuple(r.prefix): r.exists for r in lexicon.prefix_exists(asked, trie).collect()} == {("a",): False, (): True}


def test_variant_file_and_fonts(spark, tmp_path):
    path = tmp_path / "variants.json"
    path.write_text(json.dumps({"k": ["ka", "ki"], "m": []}))
    assert {tuple(r) for r in readers.variant_file(spark, str(path)).collect()} == {("k", "ka"), ("k", "ki"), ("m", None)}
    folder = tmp_path / "fonts"
    folder.mkdir()
    for name in ("one.ttf", "two.OTF", "note.txt"):
        (folder / name).write_bytes(b"x")
    found = readers.font_files(spark, {"plain": str(folder), "other": str(tmp_path / "gone")}).collect()
    assert {(r.font_stem, r.tier) for r in found} == {("one", "plain"), ("two", "plain")}


def test_trie_is_kept(spark, tmp_path):
    words = spark.createDataFrame([("ab", 2, ["a", "b"]), ("a", 1, ["a"]), ("x", 1, None)], "word string, n long, clusters array<string>")
    trie, path = lexicon.prefix_table(words), str(tmp_path / "trie")
    readers.save_trie(trie, path)
    again = readers.load_trie(spark, path)
    assert again.columns == trie.columns
    assert sorted(map(str, again.collect())) == sorted(map(str, trie.collect()))
