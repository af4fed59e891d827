"""Cases that the corpus operators once cut short."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, html_extract, neighbours, pii, toxicity

# 7 decontamination


def test_items_with_free_punctuation_short_or_without_blanks_are_found(spark):
    items = [
        "If x + y = 10 and x - y = 4 , what is x * y ?", "Où est la gare ?", "for i in range ( n ) :", "Capital of Peru", "42?", "今天天气怎么样？", "水は何度で沸騰しますか。答えを選びなさい。一番近いものはどれですか。理由も書いてください。",
        "สวัสดีครับ คุณชื่ออะไร", "😀 🎉", "中国的首都是哪里",
    ]
    changed = "水は何度で沸騰しますか。答えを選びなさい。一番近いものはこれですか。理由も書いてください。"
    texts = [f"zz yy {t} xx - ww" for t in items] + [f"zz我们说{items[5]}然后", f"そして{changed}以上", "- - zz if x, y 10: and x y 4 what is x y", "zz 美国的首都是哪里 yy", "peru of capital est la gare 今天天气 🎉 😀 142", "", None]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [{i} for i in range(len(items))] + [{5}, {6}, {0}, set(), set(), set(), set()]
    for blocks in ({}, {"block_words": 20}):
        rows = sorted(decontaminate.decontaminate(df, bench, **blocks).collect())
        assert [{m["item_id"] for m in r["matches"]} for r in rows] == want
    at = {r["doc_id"]: r["matches"][0] for r in rows if r["matches"]}
    assert [(at[i]["start"], at[i]["words"]) for i in (0, 1, 3, 4, 5, 8, 10)] == [(2, 18), (2, 4), (2, 3), (2, 1), (2, 1), (2, 2), (0, 1)] and at[0]["same"] == 12


# 8 pages


def test_only_hidden_elements_are_unseen():
    texts = lambda page: [b.text for b in html_extract.leaf_blocks(page)]
    for shown in ('class="overflow-hidden container"', 'class="overflow-x-hidden bg-white"', 'aria-hidden="false"', 'data-style="display:none"', 'title="display: none"', 'style="display:none; display:block"', "data-hidden x=hidden"):
        assert texts(f"<body {shown}><p>Seen</p></body>") == ["Seen"], shown
    for unseen in ("hidden", 'hidden=""', "HIDDEN/", 'aria-hidden="true"', "aria-hidden=true", 'style="color:red;display : none"', "style='display:none !important; display:block'"):
        assert texts(f"<div {unseen}>Unseen</div><p>Seen</p>") == ["Seen"], unseen


def test_a_head_without_end_tag_ends_at_the_body():
    head = "<html><head><meta charset=utf-8><title>T</title><link rel=x><style>a{}</style><script>b</script>"
    for body in ("<body><p>Seen</p>", "<p>Seen</p>", "</head><body><p>Seen</p>", "<body class=x>Seen", "Seen"):
        assert [b.text for b in html_extract.leaf_blocks(head + body)] == ["Seen"], body
    page = head + "<body><article><h1>A</h1><p>First text.</p></article></body></html>"
    assert html_extract.main_text(page, html_extract.default_field()) == "A\n\nFirst text."


def test_visible_elements_are_left_to_the_field():
    texts = lambda page: [b.text for b in html_extract.leaf_blocks(page)]
    assert texts("<p>If <math><semantics><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x = 2</annotation></semantics></math> holds</p>") == ["If x=2 holds"]
    assert texts("<p>a <object data=x>fallback</object> b</p>") == ["a fallback b"]
    assert texts("<svg><title/><desc>no</desc><text>One</text><text>Two</text></svg><p>End") == ["One", "Two", "End"]
    assert texts("<form><textarea>a < b</textarea><select><option>A<option>B</select><button>Go</button></form><p>End") == ["a < b", "A", "B", "Go", "End"]
    assert texts("<canvas>no</canvas><video>no</video><datalist><option>no</datalist><p>End") == ["End"]


def test_all_names_of_an_attribute_count():
    names = "wp-block-group is-layout-constrained has-global-padding alignwide sidebar comments"
    (block,) = html_extract.leaf_blocks(f'<div class="{names}">Nice read!</div>')
    assert {"sidebar", "comments"} < block.names and len(block.names) == 12
    page = f'<article><h1>A</h1><p>First text, of the article.</p><div class="{names}"><p>Nice read, thank you for it.</p></div></article>'
    assert html_extract.main_text(page, html_extract.default_field()) == "A\n\nFirst text, of the article."


def test_names_that_tell_nothing_and_linked_items():
    field = html_extract.default_field()
    menu = "<ul class=nv><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/c>Contact</a></li></ul>"
    parts = ["On the weather of the hills", "The first paragraph tells, in some words, what the weather was like last year.", "plain prose without much of anything in it", "The last paragraph closes the story."]
    page = f"<body>{menu}<div class=xyzzy><h1>{parts[0]}</h1><p>{parts[1]}</p><p>{parts[2]}</p><p>{parts[3]}</p></div><div class=ft>&copy; Hills example - Terms of use</div></body>"
    assert html_extract.main_text(page, field) == "\n\n".join(parts)
    page = "<nav><a href=/>Home</a></nav><article><h1>A title</h1><p>Some words here, and more.</p><ul><li>First item</li><li><a href=/y>Second item</a></li></ul><p>All rights reserved.</p><p>End of it.</p></article>"
    assert html_extract.main_text(page, field) == "A title\n\nSome words here, and more.\n\nFirst item\n\nSecond item\n\nAll rights reserved.\n\nEnd of it."


def test_slash_of_an_unquoted_value_closes_nothing():
    linked = lambda page: [b.linked for b in html_extract.leaf_blocks(page)]
    assert linked("<p><a href=/>Home</a></p>") == linked("<p><a href='/'>Home</a></p>") == [4] and linked("<p><a name='x'/>Home</p>") == [0]


def test_deep_pages_cost_in_proportion():
    blocks = html_extract.leaf_blocks("<div><p>x " * 50_000)
    assert len(blocks) == 50_000 and len(html_extract.default_field().decode(blocks)) == 50_000


# 9 neighbours


def test_long_vectors_of_equal_size_lose_no_neighbour():
    for dim in (1041, 1501, 2501, 4001, 4003, 9999):
        q, rows = np.ones((1, dim)), np.ones((3, dim))
        rows[0, 0] = -1
        found = neighbours.search_tile(np.array([9]), q, np.array([3, 2, 1]), rows, 1, step=1)
        assert found == [(9, 1, float(dim))], dim
        codes = np.full((1, dim), 127, dtype=np.float32)
        assert neighbours.code_products(codes, codes)[0, 0] == 127 * 127 * dim


# Pipeline


def test_near_copies_leave_one_row_of_each_class(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(4, text(1), "a")] * 50 + [(5, text(1), "b"), (5, text(2), "c"), (6, text(3), "d"), (6, text(3), "e"), (None, text(1), "f"), (None, text(4), "g"), (None, text(4), "g"), (None, text(4), "h"), (None, text(5), "i")]
    rows += [(7, None, "j"), (7, None, "j"), (None, " ", "k"), (None, " ", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.drop_near_copies(spark, df, "")
    assert out.columns == df.columns
    got = sorted(r["source"] for r in out.collect())
    assert [s for s in got if s not in "degh"] == ["a", "c", "i", "j", "j", "k", "k"]
    assert sum(s in "de" for s in got) == sum(s in "gh" for s in got) == 1
    again = corpus_pipeline.drop_near_copies(spark, df.repartition(7, "source"), "")
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


def test_many_equal_rows_fill_many_buckets(spark):
    from tessera.llm import sharding

    df = spark.createDataFrame([(1, "same words again " * 10)] * 3000 + [(i, f"other {i}") for i in range(2, 40)] + [(None, "no id")] * 50, "doc_id long, text string")
    rows = sharding.shard(df, 4, bucket_bytes=20_000).collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted(map(tuple, df.collect()), key=str)
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    places = [r.slot for r in rows if r.doc_id == 1]
    assert len({r.shard for r in rows if r.doc_id == 1}) == 1 and len(places) == 3000
    assert sorted(map(tuple, sharding.shard(df.repartition(3), 4, bucket_bytes=20_000).collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_mix_keeps_columns_of_its_own_names(spark):
    from tessera.llm import mixing

    df = spark.createDataFrame([(i, "w " * (i % 7), "abc"[i % 3], i, i, i, i) for i in range(90)], "doc_id long, text string, source string, rank int, h int, blocks int, homes int")
    m = mixing.mix(df, block_words=20, n_shards=3)
    assert sorted(tuple(r) for r in m.select(*df.columns).collect()) == sorted(map(tuple, df.collect()))
    got = m.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()
    assert all(abs(r.t - r.target) <= 3 for r in got)


def test_neighbours_of_huge_and_tiny_vectors(spark):
    rng = np.random.default_rng(8)
    for size in (1e200, 1e153, 1e-170, 1.0):
        v = rng.normal(size=(60, 5)) * size
        v[::7] /= size
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
        got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=4).orderBy("query_id", "rank").collect()
        with np.errstate(over="ignore", invalid="ignore"):
            s = neighbours.exact_products(np.repeat(v[:60:20], 60, axis=0), np.tile(v, (3, 1))).reshape(3, 60)
        s = np.where(np.isnan(s), -np.inf, s)
        for i, q in enumerate((0, 20, 40)):
            want = sorted((x for x in range(60) if x != q), key=lambda x: (-s[i, x], x))[:4]
            assert [r["vec_id"] for r in got if r["query_id"] == q] == want


def test_discovered_identifiers_induce_patterns_and_may_be_grouped_or_long(spark):
    seeds = [(i, f"the patient mailbox is p{i}@clinic.example thanks a lot") for i in range(12)]
    first = [(100 + i, f"the patient mailbox is DE{i}9 3704 0044 0532 01{i}0 00 thanks a lot") for i in range(4)]
    both = [(200 + i, f"kindly file under DE{i}9 3704 0044 0532 01{i}0 00 by noon") for i in range(4)]
    second = [(300, f"kindly file under {'Z' * 90}20481234 by noon")]
    rest = [(400, "the shop sold 12 34 56 of them in 20481234 rows")]
    df = spark.createDataFrame(seeds + first + both + second + rest, "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["pii"]] for r in pii.extract(df).collect()}
    assert all(got[i] == [(23, 50, "ctx_email")] for i, _ in first)
    assert all(got[i] == [(18, 45, "ctx_email")] for i, _ in both)
    assert got[300] == [(18, 116, "ctx_email")] and got[400] == []
    once = {r["doc_id"]: r["pii"] for r in pii.extract(df, passes=1).collect()}
    assert once[300] == [] and len(once[200]) == 1


def test_lexicon_ranks_all_terms_by_their_surety(spark):
    rows = [(i, f"common words everywhere {'vile' if i % 2 else 'fine'} t{i}", i % 2) for i in range(400)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), lexicon_size=1)
    assert set(model.lexicon.words) | set(model.lexicon.stems) == {"vile"}
    low, high = model.scores(["common words fine", "common words vile"])
    assert low < 0.1 and high > 0.9
