"""The language model learns from every training token in each round, and its vocabulary grows with the corpus."""

from uuid import uuid4

from pyspark.sql import functions as F

from barloom.llm import lm_score


def test_every_round_sees_all_training_tokens_and_the_head_grows(spark, monkeypatch, tmp_path):
    train, heads, folder = lm_score._train, [], str(tmp_path)

    def spy(known, turn):
        heads.append(known.value[0].size)
        inner = train(known, turn)

        def run(batches):
            for out in inner(batches):
                with open(f"{folder}/{turn}-{uuid4()}", "w") as f:
                    f.write(str(out.column("seen")[0].as_py()))
                yield out

        return run

    monkeypatch.setattr(lm_score, "_train", spy)
    docs = spark.createDataFrame([(i, " ".join(f"word{i}x{k}" for k in range(100)) + " the of and") for i in range(120)], "doc_id long, text string")
    got = lm_score.score(docs, F.col("doc_id") % 6 == 0, rounds=2).collect()
    for turn in range(2):
        assert sum(int(f.read_text()) for f in tmp_path.glob(f"{turn}-*")) == got[0].train_tokens == 100 * 104
    assert heads == [200] * 2  # twice the root of 10,003 words and the end
