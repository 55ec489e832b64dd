import csv
import random

import pytest

from weirworks.plans import overflow_sites

HEADER = [
    "ID", "Water company", "Site name", "River Basin District", "Receiving Environment", "Latitude", "Longitude",
    "Bathing Water Discharge Flag", *overflow_sites.FEATURES[:3], overflow_sites.TARGET,
]


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    draw = random.Random(4)
    target = tmp_path_factory.mktemp("sites") / "sites.csv"
    with open(target, "w", newline="") as file:
        writer = csv.writer(file)
        writer.writerow(HEADER)
        for i in range(200):
            spills = [draw.randint(0, 40) for _ in range(3)]
            row = [f"S{i}", f"Company {i % 3}", f'Site "{i}", north', f"Basin {i % 4}", "River", 50 + i % 5, -3 + i % 4]
            row += ["Yes" if i % 2 else "No", *spills, sum(spills) / 6]
            if i % 20 == 0:
                row[8] = "TBC"  # one year missing leaves two
            if i % 50 == 1:
                row[5] = 70  # inside the world, outside the United Kingdom
            if i % 50 == 2:
                row[5] = "Unknown"
            writer.writerow(row)
        writer.writerow(["S3", "Company 0", 'Site "3", north', "Basin 3", "River", 53, 0, "Yes", 1, 2, 3, 1])
    return str(target)


def test_read(spark, path):
    df = overflow_sites.read_table(spark, path)
    assert df.count() == 201 and dict(df.dtypes)["Latitude"] == "double"
    assert df.filter("`Latitude` is null").count() == 4
    assert df.filter("ID = 'S7'").first()["Site name"] == 'Site "7", north'


def test_clean_and_analyse(spark, path, tmp_path):
    cleaned, paths = overflow_sites.clean_table(spark, path, str(tmp_path / "world"))
    removed = {r.rule: r.rows_removed for r in spark.read.json(paths["removals"]).collect()}
    assert removed == {"missing_coordinates": 4, "short_series": 10}
    assert cleaned.count() == 201 - 14
    _, uk = overflow_sites.clean_table(spark, path, str(tmp_path / "uk"), settings=overflow_sites.UK_SETTINGS)
    removed = {r.rule: r.rows_removed for r in spark.read.json(uk["removals"]).collect()}
    assert removed["invalid_Latitude"] == 4
    tables = overflow_sites.analyse_table(cleaned)
    trends = tables["trends"].first()
    assert trends.improving + trends.worsening + trends.stable == cleaned.count()
    assert tables["companies"].agg({"site_count": "sum"}).first()[0] == cleaned.count()


def test_models(spark, path):
    df = overflow_sites.read_table(spark, path).dropDuplicates(["ID"])
    model, metrics = overflow_sites.train_table(df, trees=10)
    assert metrics.first().r2 > 0.5 and model.stages
    tables = overflow_sites.cluster_table(df, k_max=4, starts=1, max_iter=10)
    assert tables["profile"].agg({"size": "sum"}).first()[0] == df.count()
