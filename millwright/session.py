"""A session for tests, benchmarks and small jobs; a cluster brings its own."""

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """One JVM with `cpus` threads, one shuffle partition per thread."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("millwright")
    builder = builder.config("spark.driver.memory", memory)
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism)
    spark.sparkContext.setLogLevel("ERROR")
    return spark
