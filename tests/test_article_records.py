"""Catalogued articles as records."""

from factloom.sources import articles

ONE = """<PubmedArticle><MedlineCitation Status="x"><PMID Version="1"> 11 </PMID><Article><Journal><JournalIssue><PubDate><Year>2020</Year></PubDate></JournalIssue><Title>Rings</Title></Journal>
<ArticleTitle>The <i>D2</i>
 ring &amp; more</ArticleTitle><Abstract><AbstractText Label="A">First.</AbstractText><AbstractText/><AbstractText>Second.</AbstractText></Abstract>
<AuthorList><Author><LastName>Low</LastName><ForeName>Ann</ForeName></Author><Author><LastName>Bo</LastName></Author><Author><CollectiveName>Group</CollectiveName><LastName>X</LastName></Author><Author/></AuthorList></Article>
<MeshHeadingList><MeshHeading><DescriptorName>Water</DescriptorName></MeshHeading><MeshHeading><DescriptorName>Ice</DescriptorName></MeshHeading><MeshHeading><DescriptorName> Water</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="doi"/><ArticleId IdType="doi">10.1/a</ArticleId><ArticleId IdType="doi">10.1/b</ArticleId><ArticleId IdType="pmc">77</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"""
TWO = """<PubmedArticle>
<MedlineCitation><PMID>12</PMID><Article><Journal><JournalIssue><PubDate><MedlineDate>1999 Jan-Feb</MedlineDate></PubDate></JournalIssue></Journal></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="pmc">pmc9</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"""


def test_records_of_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(f'<?xml version="1.0"?>\n<PubmedArticleSet>\n{ONE}\n{TWO}<PubmedArticle><broken></PubmedArticle></PubmedArticleSet>')
    (tmp_path / "b.xml").write_text("<PubmedArticleSet></PubmedArticleSet>")
    (tmp_path / "c.xml").write_text("")
    got = {r.pmid: r for r in articles.article_records(spark, str(tmp_path)).collect()}
    assert set(got) == {"11", "12"}
    assert got["11"][1:] == ("PMC77", "10.1/a", "The D2 ring & more", "First.\nSecond.", "Rings", "2020", ["Ann Low", "Bo", "Group"], ["Water", "Ice"], True)
    assert got["12"][1:] == ("pmc9", None, "", "", "", "1999 Jan-Feb", [], [], True)


def test_many_tasks_read_one_file(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<PubmedArticleSet>" + "".join(ONE.replace(" 11 ", str(i)) for i in range(300)) + "</PubmedArticleSet>")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = articles.article_records(spark, str(tmp_path / "a.xml"))
        assert rows.rdd.getNumPartitions() > 5 and sorted(int(r.pmid) for r in rows.collect()) == list(range(300))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
