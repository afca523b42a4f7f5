"""How many planted benchmark items decontamination finds: ``python tests/llm/measure_decontamination.py [TABLES]``.

For 200 and 2,000 items, 100 of them are put verbatim and with 10, 20 and 30 %
of their words replaced into random documents.
"""

import os
import random
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


def main(tables: str) -> None:
    from pyspark.sql import SparkSession

    from groundline.llm import decontaminate

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    rows = lambda name, *columns: [tuple(r) for r in spark.read.parquet(f"{tables}/{name}.parquet").select(*columns).collect()]
    docs, base, r = rows("documents", "doc_id", "text"), rows("benchmark", "item_id", "text"), random.Random(5)
    vocabulary = [w for _, t in r.sample(docs, 200) for w in (t or "").split()]
    for total in (200, 2000):
        items = base[:total]
        while len(items) < total:  # spans of 35 words of the documents
            words = (r.choice(docs)[1] or "").split()
            if len(words) >= 60:
                at = r.randrange(len(words) - 35)
                items.append((10**6 + len(items), " ".join(words[at : at + 35])))
        planted, changed, hosts = {}, dict(enumerate(docs)), r.sample(range(len(docs)), 400)
        for j, rate in enumerate((0, 0.1, 0.2, 0.3)):
            for h, (i, t) in zip(hosts[100 * j :], r.sample(items, 100)):
                put = [w if r.random() >= rate else r.choice(vocabulary) for w in t.split()]
                words = (docs[h][1] or "").split()
                at = r.randrange(len(words) + 1)
                changed[h] = (docs[h][0], " ".join([*words[:at], *put, *words[at:]]))
                planted[docs[h][0], i] = rate
        frame = spark.createDataFrame([*changed.values()], "doc_id long, text string").repartition(8)
        found = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
        for rate in (0, 0.1, 0.2, 0.3):
            print(f"{total} items, {rate:.0%} replaced: {sum(k in found for k, v in planted.items() if v == rate)} of 100 found")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
