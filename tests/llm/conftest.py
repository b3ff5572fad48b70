import pytest


@pytest.fixture
def texts(spark):
    """``texts("a", None, ...)`` gives ``<doc_id, text, lang, source, n_chars>`` with extra columns of clashing names."""

    def make(*values):
        rows = [(i, v, "en", "s", len(v or ""), i, "x", 0) for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, k1 string, row int")

    return make


@pytest.fixture
def save_tables(spark, tmp_path):
    """Writes tables of the given rows as a data folder."""

    def save(**frames):
        for name, df in frames.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return save
