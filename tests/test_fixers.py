"""Each fixer by cases before and after."""

import pytest
from pyspark.sql import functions as F

from corpusforge.operators import fixers

CASES = [
    ("bibstems", "", "bibstem:ApJ bibstem:\"MNRAS\" bibstem:A&A.", 'bibstem:"ApJ" bibstem:"MNRAS" bibstem:"A&A."'),
    ("titles", "", 'abs:(The Formation of Massive Stars in the Orion Nebula with ALMA 2015)', "abs:(Massive AND Stars AND Orion AND Nebula)"),
    ("titles", "", 'year:2001 abs:"observations of the formation of groups during the study of research x" doctype:article', "year:2001 abs:groups doctype:article"),
    ("titles", "", "abs: (spectroscopic abundances of nearby dwarf satellites of galaxies 123) x", "abs:(spectroscopic AND abundances AND satellites AND galaxies) x"),
    ("titles", "", "abs:(the of in on at to for with by from and the of in on at to for)", "abs:(the of in on at to for with by from and the of in on at to for)"),
    ("titles", "", "abs:(a long text OR another one that has a boolean operator in it, really)", "abs:(a long text OR another one that has a boolean operator in it, really)"),
    ("titles", "", "abs:(short title)", "abs:(short title)"),
    ("titles", "", 'title:"The Formation of Massive Stars in the Orion Nebula with ALMA 2015"', 'title:"The Formation of Massive Stars in the Orion Nebula with ALMA 2015"'),
    ("alternatives", "", "abs:(the OR quasar OR H_2 OR Orion OR JWST OR spectroscopic OR mass)", "abs:(quasar AND JWST AND H_2)"),
    ("alternatives", "", "abs:(new OR small OR quasar) year:2000", "abs:(quasar AND new AND small) year:2000"),
    ("alternatives", "", "abs:(of OR at)", "abs:of"),
    ("alternatives", "", "abs:(dust OR of)", "abs:dust"),
    ("alternatives", "", "abs:(dust AND gas) abs:(dust lanes OR gas)", "abs:(dust AND gas) abs:(dust lanes AND gas)"),
    ("arguments", "", "citations(abs:cosmology)", 'citations(abs:"cosmology")'),
    ("arguments", "", "trending(abs:(exoplanets))", 'trending(abs:"exoplanets")'),
    ("arguments", "", 'similar(abs:Fermi abs:"gamma ray") abs:dust', 'similar(abs:"Fermi" abs:"gamma ray") abs:dust'),
    ("arguments", "", "abs:(exoplanets) citations(abs:x)", 'abs:(exoplanets) citations(abs:"x")'),
    ("surnames", "papers by Smith on dust", 'author:"Smith, J." abs:dust', 'author:"Smith" abs:dust'),
    ("surnames", "papers by Smith and by Levi-Civita", 'author:"^smith, J. K." author:"Levi-Civita,T"', 'author:"^Smith" author:"Levi-Civita"'),
    ("surnames", "papers by Smith J. on dust", 'author:"Smith, J."', 'author:"Smith, J."'),
    ("surnames", "dust", 'author:"Smith, J."', 'author:"Smith, J."'),
    ("balance", "", 'abs:"dust', 'abs:"dust"'),
    ("balance", "", "a (b (c", "a (b (c))"),
    ("balance", "", "a) b))", "a) b"),
    ("balance", "", "(a)))", "(a)"),
    ("balance", "", "a) b", "a) b"),
    ("fields", "", "Authors:x abstract:y years:2000 documents:z properties:p database:q facility:HST coauthors:v", "author:x abs:y year:2000 doctype:z property:p collection:q abs:HST coauthors:v"),
    ("studies", "", 'abs:"string theory" year:2000', '(abs:string OR keyword:"string theory") collection:physics year:2000'),
    ("studies", "", 'abs:"galactic dynamics" abs:"infrared astronomy"', 'abs:"galactic dynamics" (abs:infrared OR keyword:"infrared astronomy") collection:astronomy'),
]


def test_each_fixer(spark):
    rows = [(i, *c) for i, c in enumerate(CASES)]
    x = spark.createDataFrame(rows, "i int, name string, natural_language string, ads_query string, want string").withColumn("category", F.lit("x"))
    for name in fixers.FIXERS:
        for r in fixers.fix(x.where(F.col("name") == name), (name,)).collect():
            assert r.ads_query == r.want and r.fixes == ([name] if r.want != CASES[r.i][2] else []), CASES[r.i]


@pytest.mark.parametrize(
    ("query", "request_", "want"),
    [("citations(author:x)", "", "operator"), ("^author:x", "", "first_author"), ("author:x", "papers with first author x", "first_author"), ("author:x object:y", "", "author"), ("inst:x", "", "affiliation"), ("dust", "papers citing this", "operator"), ("dust", "Hubble images", "bibgroup"), ("dust", "peer reviewed", "property"), ("dust", "dust", "topic")],
)
def test_categories(spark, query, request_, want):
    x = spark.createDataFrame([(query, request_, "unfielded"), (query, request_, "kept")], "q string, nl string, c string")
    assert [r[0] for r in x.select(fixers.category_of(F.col("q"), F.col("nl"), F.col("c"))).collect()] == [want, "kept"]


def test_all_fixers_in_order(spark):
    rows = [(1, "papers by Smith", 'authors:"Smith, J. abs:(dust', "unfielded"), (2, "x", None, "author"), (3, "x", "", "unfielded")]
    got = {r.id: r for r in fixers.fix(spark.createDataFrame(rows, "id int, natural_language string, ads_query string, category string")).collect()}
    assert got[1].fixes == ["fields", "balance", "category"] and got[1].category == "author"
    assert got[2].ads_query is None and got[2].fixes == [] and got[3].fixes == ["category"]
    assert {r.fixer: r.n for r in fixers.changes(spark.createDataFrame([(["a", "b"],), (["a"],), ([],)], "fixes array<string>")).collect()} == {"a": 2, "b": 1}
