"""Inspects files on Spark; the exit code tells what was found:

    spark-submit --py-files quarrykit.zip inspect_files.py TARGET... [--json] [--known FILE] [--seconds N] [--out FOLDER]
"""

import sys

from pyspark.sql import SparkSession

from quarrykit.jobs.inspect import run

if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.getOrCreate(), sys.argv[1:]))
