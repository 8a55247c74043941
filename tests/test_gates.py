"""The title and front-matter gates, case by case."""

import pytest
from pyspark.sql import functions as F

from tidewheel.functions import phrases
from tidewheel.operators import candidates

PAPER = "A new assay for cryo-EM structures of membrane proteins"
CASES = [
    # title, abstract, section, skip reason
    ("Front Cover: Molecular Catalysts", "Cover picture information.", "research", "cover"),
    ("Issue Publication Information", "Volume 21, issue 5.", "research", "masthead"),
    ("Introducing Our Authors", "", "research", "masthead"),
    (PAPER, "We solve it.\nIntroducing our authors\nThey are many.", "research", None),
    (PAPER, "We solve it.\nIssue editorial masthead", "research", None),
    (PAPER, "First line\nCorrection: a line of the abstract", "research", None),
    (PAPER, "The inside\n cover of the cell", "research", "cover"),
    ("Author Correction: A de novo designed protein", "", "research", "not_research"),
    ("Publisher Correction: Nanostructure assembly", "", "research", "not_research"),
    ("Retraction Note: Prior claims", "", "research", "not_research"),
    ("Research Highlights", "", "research", "not_research"),
    ("News & Views: Form follows function", "", "research", "not_research"),
    ("Biotech news from around the world", "", "research", "not_research"),
    ("A correction-free error model for DNA origami", "A new method.", "research", None),
    ("De novo design of ligand binding proteins", "A new method.", "research", None),
    ("How do I stand out in a job interview?", "", "research", "not_research"),
    ("How to write a paper that lands a faculty job", "", "research", "not_research"),
    ("How to write fast code\nand a paper about it", "A new method.", "research", None),
    ("How the ribosome selects tRNA during elongation", "A new method.", "research", None),
    ("Charge transport in a DNA-templated nanowire", "A new method.", "research", None),
    ("Prominent researcher indicted on fraud charges", "", "research", "not_research"),
    ("Author Correction: in another section", "", "industry", None),
    ("", "A new method.", "research", "empty"),
]


def test_skip_reasons(spark):
    rows = [(i, *c[:3], "Nature") for i, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, "item_id long, title string, abstract string, section string, source string")
    got = {r.item_id: r.why for r in df.select("item_id", candidates.skip_reason().alias("why")).collect()}
    assert [(c[0], got[i]) for i, c in enumerate(CASES)] == [(c[0], c[3]) for c in CASES]


@pytest.mark.parametrize(
    ("title", "blocked"),
    [("Volume 3 of the journal", True), ("editorial: ahead", True), ("Editorials of the year", False), ("Sponsored: buy", True), ("A study\nEditorial", False), ("Table of contents", True), ("An erratum", False), ("Show HN: a tool", True), ("Corrections officers", False), ("In this issue: all", True)],
)
def test_blocked_titles(spark, title, blocked):
    assert spark.createDataFrame([(title,)], "t string").select(F.col("t").rlike(phrases.BLOCKED_TITLES)).first()[0] is blocked
