import gzip

from pyspark.sql import functions as F

from glyphmill.functions import tokenize
from glyphmill.sources import readers


def one(spark, text, f, name="value"):
    return spark.createDataFrame([(text,)], f"{name} string").select(f(F.col(name)).alias("x")).first()["x"]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("one two\nthree\n")
    with gzip.open(tmp_path / "sub" / "b.txt.gz", "wt", encoding="utf-8") as f:
        f.write("vier é\n")
    (tmp_path / "c.log").write_text("no")
    names = readers.list_files(str(tmp_path), r".*\.txt(\.gz)?")
    assert [n.rsplit("/", 1)[1] for n in names] == ["a.txt", "b.txt.gz"]
    assert sorted(r.value for r in readers.read_lines(spark, names).collect()) == ["one two", "three", "vier é"]
    docs = readers.read_documents(spark, names[:1]).collect()
    assert len(docs) == 1 and docs[0].value == "one two\nthree\n" and docs[0].key.endswith("a.txt")
    (tmp_path / "list").write_text(f"# weights\n0.5\t{names[0]}\n2\t{names[1]}\n")
    got = {(r.value, r.weight) for r in readers.read_weighted_lines(spark, str(tmp_path / "list")).collect()}
    assert got == {("one two", 0.5), ("three", 0.5), ("vier é", 2.0)}
    (tmp_path / "sub two=2").mkdir()
    (tmp_path / "sub two=2" / "a.txt").write_text("again\n")
    (tmp_path / "list").write_text(f"0.5\t{names[0]}\n2\t{tmp_path}/sub two=2/a.txt\n")
    got = [(r.value, r.weight) for r in readers.read_weighted_lines(spark, str(tmp_path / "list")).collect()]
    assert sorted(got) == [("again", 2.0), ("one two", 0.5), ("three", 0.5)]
    (tmp_path / "none").write_text("# nothing\n")
    assert readers.read_weighted_lines(spark, str(tmp_path / "none")).count() == 0


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a", 3), ("b", 1), ("a", 3)], "key string, value int")
    readers.write_counts(d.distinct(), str(tmp_path / "counts"), threshold=2)
    assert [r.value for r in readers.read_lines(spark, str(tmp_path / "counts")).collect()] == ["a\t3"]
    readers.write_keys(d, str(tmp_path / "keys"))
    assert sorted(r.value for r in readers.read_lines(spark, str(tmp_path / "keys")).collect()) == ["a", "b"]


def test_messages(spark, tmp_path):
    text = '<message key=u1 label="1.5">\nhello there\nyou\n</message>\n<message key="u2" label=UNK>\nx\n</message>\n<message key=u3>\n\n</message>\n'
    (tmp_path / "m").write_text(text)
    got = sorted((r.key, r.label, r.content) for r in readers.read_messages(spark, str(tmp_path / "m")).collect())
    assert got == [("u1", "1.5", ["hello", "there", "you"]), ("u3", None, [])]


def test_line_parsers(spark):
    assert one(spark, "A|b c|D", lambda c: readers.columns(c, r"\|", [2, 1, 7])) == ["D", "b c", None]
    assert one(spark, "A|b c|D", lambda c: readers.columns(c, r"\|", [2, 1], lower=True, tokenizer=tokenize.whitespace)) == ["d", "b", "c"]
    x = one(spark, "-1 3:0.5 w:2 # why", readers.svmlight)
    assert x.label == "-1" and x.fields == {"3": 0.5, "w": 2.0}
    assert one(spark, "7", readers.svmlight).fields == {}
    x = one(spark, "a,b\tsome  words ", readers.labelled)
    assert x.labels == ["a", "b"] and x.content == ["some", "words"]
    x = one(spark, "(S (NP (NN dog)) (VP (VB runs)))", readers.treebank_leaves)
    assert x.content == ["dog", "runs"] and x.pos == ["NN", "VB"]
    x = one(spark, "1\tMe\tHi @You_2\t#Tag http://x.y/z [end", readers.tweets)
    assert x.author == "me" and x.content == ["hi", "@you_2", "#tag", "http://x.y/z", "end"]
    assert one(spark, "a  b \nc", readers.document_tokens) == ["a", "", "b", "c"]
    assert one(spark, "<r><token><solution><part>x</part></solution></token></r>", readers.lattice) == [[["x"]]]
    d = readers.dictionary(spark.createDataFrame([("a\tb",), ("a\tc\t0.25",)], "value string")).collect()
    assert [tuple(r) for r in d] == [("a", "b", 1.0), ("a", "c", 0.25)]


def test_merge_by_key_keeps_the_first_record(spark):
    d = spark.createDataFrame([("k", 2, ["b"], "y"), ("k", 1, ["a", "c"], "x")], "key string, seq int, content array<string>, label string")
    r = readers.merge_by_key(d, "key", "seq", "content", ["label"]).first()
    assert r.label == "x" and r.content == ["a", "c", "b"] and r.num_observations == 2 and [c.seq for c in r.communications] == [1, 2]


def test_feature_ids_are_dense_and_sorted(spark):
    names = [f"f{i:03d}" for i in range(300)]
    d = spark.createDataFrame([(n,) for n in reversed(names)], "feature string").repartition(5)
    assert {r.feature: r.id for r in readers.feature_ids(d).collect()} == {n: i + 1 for i, n in enumerate(names)}


def test_tokenizers(spark):
    assert one(spark, 'He said, "I can\'t (really)." It\'s 3--4... Gimme!', tokenize.treebank) == ["He", "said", ",", "``", "I", "ca", "n't", "(", "really", ")", ".", "''", "It", "'s", "3", "--", "4", "...", "Gim", "me", "!"]
    assert one(spark, "He cannot be wrong.", tokenize.treebank) == ["He", "can", "not", "be", "wrong", "."]
    assert one(spark, "Wait... a.b is e.g. fine. ¿No? “x”", tokenize.basic) == ["Wait", "...", "a.b", "is", "e.g", ".", "fine", ".", "¿", "No", "?", "“", "x", "”"]
    assert one(spark, "“a” ♥ it—really…", tokenize.symbols) == '"a" <3 it-really...'
    assert one(spark, "no!!!!! hahahahaha jajaja hmmmm .... a..", tokenize.repeats) == "no!!! hahaha jaja hmm ... a.."
    assert one(spark, "  ", tokenize.whitespace) == []
    table = tokenize.read_symbols(["# codes", "1f600,[grin]", "2605,*"])
    assert one(spark, "a😀★", lambda c: tokenize.symbol_table(c, table)) == "a[grin]*"


def test_tweet_tags(spark):
    tags = tokenize.tag_tweet("@ann loves x@y.org :) <3 #fun http://a.b/c --> 12% 👍 soooo!!!")
    assert [(t, k) for t, k, _ in tags] == [("@ann", "MENTION"), ("loves", "TOKEN"), ("x@y.org", "EMAIL"), (":)", "EMOTICON"), ("<3", "HEART"), ("#fun", "HASHTAG"), ("http://a.b/c", "URL"), ("-->", "ARROW"), ("12%", "NUMBER"), ("👍", "SYMBOL"), ("soooo", "TOKEN"), ("!!!", "REPEAT")]
    text = "@ann loves x@y.org :) <3 #fun http://a.b/c --> 12% 👍 soooo!!!"
    assert all(text[s : s + len(t)] == t for t, _, s in tags)
    assert tokenize.tag_tweet(None) == [] and tokenize.tag_tweet(" ") == []
    got = one(spark, "see http://a.b", lambda c: tokenize.tweet_tags(c, ("URL",)))
    assert [g.token for g in got] == ["see", "[URL]"]
