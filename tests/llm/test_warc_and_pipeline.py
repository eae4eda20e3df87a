import hashlib
import json
import time
from html.parser import HTMLParser

import corpus_pipeline
from pathloom.llm import warc
from tests.llm.data import documents, empty

PAGES = [
    (1, "http://a.example/x?y=1", '<html lang="de"><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><b>";</script></head><body><!-- no --><p>One <b>two</b></p><div>three&nbsp;&eacute;<br>four</div><a href="/q?a=1&amp;b=2">l</a></body></html>'),
    (2, None, "plain < text > & more"),
    (3, "http://b.example/", None),
    (4, "http://c.example/", ""),
    (5, "http://d.example/", '<p title="a > b">x</p><script>unclosed'),
]


class Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.quiet = [], 0

    def handle_starttag(self, tag, attrs):
        self.quiet += tag in warc.SILENT
        if tag in warc.BREAKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.quiet -= tag in warc.SILENT
        if tag in warc.BREAKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.quiet:
            self.out.append(data)


def lines(text):
    return [" ".join(x.split()) for x in text.split("\n") if x.split()]


def test_derivatives(spark):
    pages = spark.createDataFrame(PAGES + [PAGES[0]], "page_id long, url string, html string")
    source = {r.page_id: r for r in warc.responses(pages).collect()}
    got = warc.derivatives(warc.responses(pages)).collect()
    assert len(got) == 12
    for r in got:
        s = source[r.page_id]
        assert (r.refers_to, r.target_uri, r.source_digest, r.date) == (s.record_id, s.target_uri, s.payload_digest, s.date)
        assert r.block_digest == warc.digest(r.block.encode()) and r.content_length == len(r.block.encode())
        assert s.payload_digest == warc.digest(bytes(s.payload))
        if r.warc_type == "metadata":
            j = json.loads(r.block)
            assert j["source"]["WARC-Record-ID"] == s.record_id and ["Content-Length", str(len(s.payload))] in j["http"]["headers"]
            assert r.concurrent_to in {x.record_id for x in got if x.warc_type == "conversion" and x.page_id == r.page_id}
    by = {(r.page_id, r.warc_type): r for r in got}
    assert json.loads(by[1, "metadata"].block)["html"] == {"title": "T & t", "lang": "de", "description": None, "links": ["/q?a=1&b=2"]}
    assert by[1, "conversion"].block == "T & t\nOne two\nthree é\nfour\nl"
    assert by[2, "conversion"].block == "plain < text > & more" and by[3, "conversion"].block == "" and by[5, "conversion"].block == "x"


def test_text_against_a_parser(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for r in table:
        p = Text()
        p.feed(r.html)
        p.close()
        assert lines(warc.text_of(r.html)) == lines("".join(p.out))


def test_hostile_pages_take_linear_time():
    for part in ("<meta name ", "<a ", "<a href=", "<html ", "<title>", "<script>", "<!--", "<a x='", '<a x="', "<", "</", "&#", " \n", "<a href= "):
        page = part * (1_000_000 // len(part))
        began = time.process_time()
        warc.page_metadata(page)
        warc.text_of(page)
        assert time.process_time() - began < 3, part


def test_metadata_of_odd_markup():
    page = "<HTML LANG=en-GB><title>a<b</title><meta content='x  y' NAME=description><a class=q href=u>1</a><a href>2</a><a href='v&amp;w'>3</a><!-- <a href=no> --><title>no</title>"
    assert warc.page_metadata(page) == {"title": "a<b", "lang": "en-GB", "description": "x y", "links": ["u", "", "v&w"]}
    assert warc.text_of("a<br/>b<p class=x>c</p><script src=a>no</script >d<style>e") == "a\nb\nc\nd"
    assert warc.text_of("one <a href='x two") == "one"


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    records = warc.derivatives(warc.responses(pages))
    members = warc.serialised(records).collect()
    (tmp_path / "a.warc.gz").write_bytes(b"".join(bytes(m.member) for m in members[:4]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(bytes(m.member) for m in members[4:]))
    key = lambda df: sorted(map(str, df.select(*[n for n, _ in warc._OUT]).collect()))
    assert key(warc.read(spark, str(tmp_path))) == key(records)
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_stages(spark, tmp_path):
    cols = list(corpus_pipeline.COLUMNS)
    bench = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(30)))], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    base = documents(spark).select(*cols)
    dirty = spark.createDataFrame([(700, "some words " * 3 + " ".join(f"q{i}" for i in range(30)), "a", "s0", 9)], base.schema)
    base.unionByName(dirty).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == cols, name
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        a, b = {r.doc_id for r in docs.collect()}, {r.doc_id for r in before.collect()}
        assert a <= b and docs.count() == len(a)
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in docs.collect() if r.doc_id != 700)
        assert stage(spark, empty(spark).select(*cols), str(tmp_path)).count() == 0
    assert 700 not in a
    assert docs.count() > 30
    pieces = corpus_pipeline.curve_packing(spark, docs, str(tmp_path))
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == a
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert run.count() == pieces.count()
