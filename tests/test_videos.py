from pyspark.sql import functions as F
from test_store import change, frame, stored

from vesper.operators.encode import HashEncoder
from vesper.operators.summary import run_report
from vesper.operators.videos import Modality, index_videos
from vesper.schemas import LISTING
from vesper.sources.store import Store


def extract(log, bad=()):
    """Content of each sample; none for some names. Notes which files were read."""

    def run(samples):
        def read(batches):
            for b in batches:
                with open(log, "a") as f:
                    f.writelines(p + "\n" for p in b.column("path").to_pylist())
                yield b

        noted = samples.mapInArrow(read, samples.schema)
        gone = F.lit(False)
        for name in bad:
            gone = gone | F.col("path").contains(name)
        return noted.withColumn("content", F.when(~gone, F.concat("path", F.col("pos").cast("string")).cast("binary")))

    return run


def listed(spark, *names):
    return spark.createDataFrame([(f"/v/{n}.mp4", "/v", None if n == "nosize" else 100, 1, i) for i, n in enumerate(names)], LISTING)


def durations(files):
    return files.withColumn("duration", F.when(F.col("path").contains("mute"), None).when(F.col("path").contains("point"), 0.0).otherwise(120.0))


def test_one_flow(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=2)
    store.upsert(frame(spark, change("/v/known.mp4", 100, clip=[1.0], ns="video"), change("/v/zero.mp4", 100, clip=[0.0], ns="video"), change("/v/stale.mp4", 99, clip=[1.0], ns="video")), 1)
    frames, sound = Modality(extract(tmp_path / "frames", ("noframe", "nothing")), HashEncoder), Modality(extract(tmp_path / "sound", ("silent", "nothing")), HashEncoder)
    files = listed(spark, "known", "zero", "stale", "noframe", "silent", "nothing", "mute", "point", "nosize")
    out = index_videos(files, store, durations, frames, sound, 9)
    rows = {r["path"][3:-4]: (r["outcome"], r["message"]) for r in out.collect()}
    assert rows.pop("nothing")[1].startswith("no frame at ") and rows.pop("mute") == ("skipped", "can't read the duration")
    assert rows.pop("point") == ("skipped", "no features") and rows.pop("nosize") == ("write_failed", "file can't be read")
    assert set(rows.values()) == {("processed", None)} and len(rows) == 5
    assert tuple(run_report(out).first()) == (6, 3, 1)
    held = stored(store)
    assert held[("video", "/v/noframe.mp4")]["clip_vector"] is None and len(held[("video", "/v/noframe.mp4")]["audio_vector"]) == 32
    assert held[("video", "/v/silent.mp4")]["audio_vector"] is None and held[("video", "/v/known.mp4")]["updated_at"] == 1 and held[("video", "/v/stale.mp4")]["updated_at"] == 9
    read = (tmp_path / "frames").read_text()
    assert "known" not in read and "mute" not in read and len({*read.split()}) * 2 <= len(read.split())
    once = len(read.split())
    again = index_videos(files.where("path NOT LIKE '%/no%'"), store, durations, frames, sound, 10)
    assert again.where("outcome = 'processed'").count() == 4 and len((tmp_path / "frames").read_text().split()) == once


def test_missing_encoders_are_reasons(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=1)
    gone = Modality(error="no weights")
    out = index_videos(listed(spark, "a"), store, durations, gone, Modality(error="no ffmpeg"), 1).collect()
    assert [tuple(r) for r in out] == [("/v/a.mp4", "skipped", "no frame encoder: no weights; no audio encoder: no ffmpeg")]
    out = index_videos(listed(spark, "a"), store, durations, gone, Modality(extract(tmp_path / "s1"), HashEncoder), 1).collect()
    assert out[0]["outcome"] == "processed" and store.read().count() == 1
    assert index_videos(listed(spark, "a").limit(0), store, durations, gone, gone, 1).count() == 0
