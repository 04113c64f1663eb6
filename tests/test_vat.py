"""VAT numbers of all prefixes: published examples and the same with one digit changed."""

from pyspark.sql import functions as F

from quillmark.functions import identifiers as ids

#: Published examples of valid numbers.
VALID = (
    "ATU13585627", "BE0403019261", "BG175074752", "CY10259033P", "CZ25123891", "DE136695976", "DK13585628", "EE100931558", "EL094259216", "ESB58378431", "ESX5910266W", "ES54362315K",
    "FI20774740", "FR40303265045", "FR83404833048", "HR33392005961", "HU12892312", "IE6433435F", "IE6433435OA", "IT00743110157", "LT119511515", "LT100001919017", "LU15027442", "LV40003521600",
    "MT11679112", "NL004495445B01", "PL8567346215", "PT501964843", "RO18547290", "SE123456789701", "SI50223054", "SK2022749619", "XI980780684",
)


def test_check_digits_of_all_prefixes(spark):
    changed = []
    for v in VALID:
        at = next(i for i in range(len(v) - (3 if v[:2] in ("NL", "SE") else 2), 3, -1) if v[i].isdigit())
        changed.append(v[:at] + str((int(v[at]) + 1) % 10) + v[at + 1 :])
    rows = spark.createDataFrame([(v, True) for v in VALID] + [(v, False) for v in changed], "value string, fine boolean")
    got = rows.select("value", "fine", ids.eu_vat(F.col("value"))["valid"].alias("valid")).collect()
    assert [r["value"] for r in got if r["fine"] and not r["valid"]] == []
    assert [r["value"] for r in got if not r["fine"] and r["valid"]] == []
    assert {v[:2] for v in VALID} == set(ids.VAT_STRUCTURES)
