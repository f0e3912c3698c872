"""Clean a CSV of raw readings, add features, write and print the report.

spark-submit --py-files millwright.zip run_report.py INPUT.csv OUTPUT_FOLDER
"""

import sys

from pyspark.sql import SparkSession

from millwright.plans import job
from millwright.sources import readings


def main(source: str, folder: str) -> None:
    spark = SparkSession.builder.appName("equipment report").getOrCreate()
    featured = job.prepare(readings.read_csv(spark, source, keep_order=True), f"{folder}/features")
    job.write_report(featured, folder)
    for name in job.REPORT:
        print(name)
        spark.read.parquet(f"{folder}/{name}").show(truncate=False)


if __name__ == "__main__":
    main(*sys.argv[1:])
