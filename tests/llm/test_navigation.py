"""Operator 8: which lines are navigation by their separators."""

import pytest
from pyspark.sql import functions as F

from lumispec.llm import quality

PROSE = "word " * 30


@pytest.mark.parametrize("line, navigation", [
    ("Home | About us | Contact | Sitemap", True),
    ("Start » Shop » Shoes » Red boots", True),
    ("Home › News › World › Today", True),
    ("Il a dit « bonjour » puis « merci » et enfin « au revoir » avant de partir", False),
    ("Er sagte »ja«, dann »nein« und am Ende »vielleicht« zu allen", False),
    ("Elle lit «un», «deux», «trois» et «quatre»", False),
    (f"{PROSE}| {PROSE}| {PROSE}| {PROSE}", False),
    (f"{PROSE}» {PROSE}» {PROSE}» {PROSE}", False),
])
def test_separators(spark, line, navigation):
    assert spark.range(1).select(quality.line_fails(F.lit(line)).alias("x")).first().x is navigation
