"""Shuffle files that no later step reads."""

import time

from loomtext.llm import neardup
from loomtext.llm._shared import Workspace


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_texts_dealt_for_sampling_are_gone_before_the_next_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i % 7) * 3 + j}" for j in range(30))) for i in range(200)], "doc_id long, text string").repartition(4)
    made, left, save = set(), {}, Workspace.save

    def watched(self, df, name):
        if name in ("pivots", "links"):  # the next steps after the texts were dealt
            end = time.time() + 10
            while (held := shuffle_files(spark) & made) and time.time() < end:
                time.sleep(0.2)
            left[name] = len(held)
        before = shuffle_files(spark)
        out = save(self, df, name)
        if name in ("sampled", "texts"):
            made.update(shuffle_files(spark) - before)
        return out

    monkeypatch.setattr(Workspace, "save", watched)
    assert neardup.near_duplicates(docs).select("cluster_id").distinct().count() == 7
    assert made and left == {"pivots": 0, "links": 0}
