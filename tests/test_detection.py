import pytest
from pyspark.sql import functions as F

from voxloom.operators import detection

PT = "a minha irmã não encontrou pão no mercado e voltou mais tarde para casa com o amigo dela"
SAMPLES = {
    "pt": "o carro da minha mãe está na rua e ontem de manhã fui ao mercado com um amigo quando vi que não havia pão nem leite para a semana inteira ele disse que ia mais tarde à cidade e que eu não devia esperar por ele em casa",
    "en": "so the weather forecast said that it would rain throughout the whole day and we probably should not have gone out to the market without our coats because the wind was cold and there was nothing left for the weekend",
    "es": "el coche de mi madre está en la calle y ayer por la mañana fui al mercado con un amigo cuando vi que no había pan ni leche para toda la semana él dijo que iría más tarde a la ciudad y que yo no debía esperarlo en casa",
    "de": "das auto meiner mutter steht auf der straße und gestern morgen ging ich mit einem freund auf den markt als ich sah dass es weder brot noch milch für die ganze woche gab er sagte dass er später in die stadt gehen würde",
}


@pytest.fixture(scope="module")
def small(spark):
    return detection.fitted(spark.createDataFrame([(t, k) for k, t in SAMPLES.items()] + [(None, "xx"), ("text", None)], "text string, language string"))


def found(spark, detector, text, codes):
    row = detection.detected(spark.createDataFrame([(text, codes)], "text string, codes array<string>"), detector, codes="codes").first()
    return row.output_language


@pytest.mark.parametrize(
    "text,codes,want",
    [
        (PT, ["en", "pt", "es"], "pt"),
        ("ah sim", ["en", "pt"], None),
        (PT, ["en", "pt-BR"], "pt"),
        (PT, ["EN", "PT_br"], "pt"),
        (PT, ["eng", "por"], "pt"),
        ("well nobody should have gone out without a coat because there was rain and wind for the whole day", ["zh", "yue", "en", "ja", "ko"], "en"),
        (PT, ["yue"], None),
        (PT, [], "pt"),
        (PT, None, "pt"),
        ("", ["pt"], None),
        ("12 34 !", [], None),
        (None, [], None),
    ],
)
def test_allow_lists(spark, small, text, codes, want):
    assert found(spark, small, text, codes) == want


def test_held_out_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang IS NOT NULL AND length(text) > 100")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    detector = detection.fitted(rows.filter(~held).select("text", F.col("lang").alias("language")))
    out = detection.detected(rows.filter(held), detector).agg(F.avg((F.col("detected.language") == F.col("lang")).cast("int")), F.avg(F.col("output_language").isNotNull().cast("int")), F.avg((F.col("output_language") == F.col("lang")).cast("int"))).first()
    assert out[0] > 0.98 and out[1] > 0.9 and out[2] > 0.99


def test_counts_are_those_of_all_texts(spark):
    rows = [(t[k::7], x) for x, t in SAMPLES.items() for k in range(7)]
    one = detection.fitted(spark.createDataFrame(rows, "text string, language string").repartition(5))
    want = {x: sum(detection.np.bincount(detection.gram_buckets(t), minlength=detection.BUCKETS) for t, y in rows if y == x) for x in SAMPLES}
    again = detection.Detector(sorted(want), detection.np.array([want[x] for x in sorted(want)]))
    assert one.languages == again.languages and (one.logs == again.logs).all()
