"""Operator 3: target models count all labels, also those beyond the sample for thresholds."""

from sectorpulse.llm import quality


def test_target_counts_do_not_stop_at_the_sample(spark, frame, monkeypatch):
    rows = [(k, f"common word{k % 40} text") for k in range(600)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 600, 2)], "doc_id long, quality int, toxic int")
    fitted, fit = [], quality.fit_models
    monkeypatch.setattr(quality, "fit_models", lambda given: fitted.append(fit(given)) or fitted[-1])
    most = quality.resample(frame(rows), labels, labelled_rows=50).collect()
    word = int(quality.features("common")[0][0])
    assert [m.counts[2][word] for m in fitted] == [300] and [m.counts[0][word] for m in fitted] == [600]
    # The same by a shuffle of the labels.
    monkeypatch.setattr(quality, "BROADCAST_KEYS", 10)
    again = quality.resample(frame(rows), labels, labelled_rows=50).collect()
    assert fitted[1].counts[2][word] == 300 and sorted(most) == sorted(again)
