import pytest

from kit import CONFIG
from tillproof.plans.bundle import bundle_manifest, run_bundle
from tillproof.plans.run import run_folder
from tillproof.sources import files, sinks

STORES = "store_id,store_name,city,state,zip_code,region,opened_date\nS1,A,Rome,NY,14604,Northeast,2010-01-01\nS2, B ,Bend,OR,0938,,2011-01-01\nS3,C,Bend,OR,97001,West,2012-01-01\n"
PRODUCTS = 'product_id,product_name,category,unit_price,supplier_id\nP1,"Cap, red",Apparel,10.00,V\nP2,Mug,,5.00,V\n'
SALES = "transaction_id,transaction_date,store_id,product_id,customer_id,quantity,unit_price,total_amount\nT1,2026-05-15,S1,P1,C1,2,10.00,20.00\nT2,05/16/2026,S2,P2,,1,5.00,$5.00\nT2,05/16/2026,S2,P2,,1,5.00,$5.00\nT3,2026-05-15,S9,P1,NA,1,10.00,10.00\n"


@pytest.fixture
def folder(tmp_path):
    for name, body in (("stores", STORES), ("products", PRODUCTS), ("transactions", SALES)):
        (tmp_path / f"{name}.csv").write_text(body)
    return str(tmp_path)


def test_text_stays_text(spark, folder):
    stores = files.read_text_csv(spark, f"{folder}/stores.csv").orderBy("store_id").collect()
    assert stores[1].zip_code == "0938" and stores[1].region is None and stores[1].store_name == " B "
    sales = {r.transaction_id: r for r in files.read_text_csv(spark, f"{folder}/transactions.csv").collect()}
    assert sales["T3"].customer_id is None  # NA is a missing-value word in a file
    kept = {r.transaction_id: r for r in files.read_text_csv(spark, f"{folder}/transactions.csv", keep_blank_as_na=False).collect()}
    assert kept["T3"].customer_id == "NA" and kept["T2"].customer_id == ""
    assert files.read_text_csv(spark, f"{folder}/products.csv").first().product_name == "Cap, red"


def test_missing_file_raises(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_feed(spark, str(tmp_path))


def test_source_row_is_the_place_in_the_file(spark, tmp_path):
    lines = ["a,b"] + [f"{i},x{i}" for i in range(5000)]
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = files.with_source_row(spark, files.read_text_csv(spark, str(tmp_path / "t.csv")), "t")
        got = [(r.source_row, r.a) for r in df.orderBy("source_row").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(i, str(i)) for i in range(5000)]


def test_parquet_places_continue_over_files(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(0, 1000, 1, 4).write.parquet(path)
    places = [r.pos for r in files.parquet_with_row_place(spark, path).collect()]
    assert sorted(places) == list(range(1000))


def test_json_has_no_bad_numbers(spark, tmp_path):
    df = spark.sql("select 1 as i, double('NaN') as a, double('-Infinity') as b, date'2026-01-02' as d")
    path = sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.text(path).first()[0] == '{"i":1,"a":null,"b":null,"d":"2026-01-02"}'


def test_quarantine_appends(spark, tmp_path):
    one = spark.createDataFrame([("t", "TX-04", 1, "x")], "dataset string, reason_code string, n int, extra string")
    two = one.drop("extra")
    path = str(tmp_path / "q")
    sinks.quarantine_sink([one, two], path)
    sinks.quarantine_sink([two], path)
    back = spark.read.option("header", True).csv(path)
    assert back.count() == 3


def test_whole_run_over_a_folder(spark, folder, tmp_path):
    result = run_folder(spark, folder, CONFIG, output=str(tmp_path / "out"))
    assert {r.source_row: r.disposition for r in result.workspace.lineage.collect()} == {0: "kept", 1: "kept", 2: "dropped", 3: "quarantined"}
    assert result.problems.count() == 0  # no expected counts given: every class was looked for
    assert result.metrics["revenue_reconciliation"].first().net_revenue == 25.0
    assert result.bundle.filter("section = 'metadata'").first().record.startswith('{"as_of":"2026-06-02"')
    manifest = {r.section: r.records for r in spark.read.json(str(tmp_path / "out" / "bundle" / "manifest")).collect()}
    assert manifest["metrics.revenue_reconciliation"] == manifest["metadata"] == 1 and manifest["coverage"] == 17
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "cleaned" / "transactions")).count() == 2


def test_a_long_report_is_bundled_whole(spark):
    bundle = run_bundle({"as_of": "2026-06-02"}, {"stores": spark.range(150_000)}, {"empty": spark.range(0)})
    assert {r.section: r.records for r in bundle_manifest(bundle).collect()} == {"metadata": 1, "stores": 150_000}
