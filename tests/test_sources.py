import os
import tempfile
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from paracorpus.operators import pairing as P
from paracorpus.sources import audio as A
from paracorpus.sources import cache, catalog, corpus_tree, examples, folders, participants, recordings, units


@pytest.fixture(scope="module")
def folder():
    return tempfile.mkdtemp(prefix="run-")


def write(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as handle:
        handle.write(content if isinstance(content, bytes) else content.encode("utf-8"))


@pytest.fixture(scope="module")
def tree(folder):
    root = f"{folder}/tree"
    texts = {
        "P-1_001": " First sentence. \n", "P-1_002": "  \n ", "P-2_001": "No audio here",
        "P-9_001": "Two, \"types\"", "a.b": "Dotted name", "x y+z %41": "Odd näme",
    }
    for name, text in texts.items():
        write(f"{root}/train/TXT/{name}.txt", text)
    for name in ["P-1_001.wav", "P-1_002.wav", "P-9_001.wav", "P-9_001.mp3", "a.wav", "a.b.wav", "x y+z %41.wav"]:
        write(f"{root}/train/AUDIO/{name}", b"not read")
    write(f"{root}/train/TXT/nested/inner.txt", "in a sub-folder")
    write(f"{root}/test/TXT/P-2_009.txt", "A test text")
    write(f"{root}/test/AUDIO/P-2_009.m4a", b"")
    write(
        f"{root}/Participant_meta_data.csv",
        'PARTICIPANT ID,Dialect,Age Group,Gender,Note\n P-1 ,old,18-30,f,x\n,none,1,m,blank id\n'
        'P-2,,30-45,m,"quoted\nline"\nP-1,new,18-30,,"later ""row"""\n',
    )
    return root


def test_texts_and_paths(spark, tree):
    texts, audio = corpus_tree.read_corpus_tree(spark, tree, "train")
    found = {r.stem: r.text for r in texts.collect()}
    assert found["P-1_001"] == "First sentence." and found["P-1_002"] == "" and found["x y+z %41"] == "Odd näme"
    assert len(found) == 6 and "inner" not in found
    paths = {(r.stem, os.path.basename(r.path)) for r in audio.collect()}
    assert ("a.b", "a.b.wav") in paths and ("a", "a.wav") in paths and ("x y+z %41", "x y+z %41.wav") in paths
    assert len(paths) == 7
    assert {r.stem for r in corpus_tree.list_files(spark, f"{tree}/train/AUDIO", ".mp3").collect()} == {"P-9_001"}


def test_listing_does_not_read_contents(spark, tree, capsys):
    corpus_tree.list_files(spark, f"{tree}/train/AUDIO").explain()
    assert "Scan binaryFile" not in capsys.readouterr().out


def test_tree_examples(spark, tree):
    df = corpus_tree.read_tree_examples(spark, tree, "train")
    assert df.columns == P.EXAMPLE_COLUMNS and {t for _, t in df.dtypes} == {"string"}
    rows = {r.id: r for r in df.collect()}
    assert set(rows) == {"P-1_001", "P-9_001", "a.b", "x y+z %41"}
    first = rows["P-1_001"]
    assert (first.participant_id, first.dialect, first.age_group, first.gender) == ("P-1", "new", "18-30", None)
    assert first.transcript is None and first.audio.endswith("/train/AUDIO/P-1_001.wav")
    assert rows["P-9_001"].audio.endswith(".mp3"), "the smallest path of a stem is taken"
    assert (rows["P-9_001"].participant_id, rows["P-9_001"].dialect) == ("P-9", None)
    assert rows["a.b"].audio.endswith("a.b.wav") and rows["a.b"].participant_id is None


def test_participants(spark, tree):
    rows = {r.participant_id: r for r in participants.read_participants(spark, f"{tree}/Participant_meta_data.csv").collect()}
    assert set(rows) == {"P-1", "P-2"} and rows["P-1"].dialect == "new"
    missing = participants.read_participants(spark, f"{tree}/absent.csv")
    assert missing.count() == 0 and missing.columns[0] == "participant_id"
    df = spark.createDataFrame([("P-1_x",), ("free",)], "stem string")
    assert {r.dialect for r in P.with_participants(df, missing, "stem").collect()} == {None}


def test_recordings(spark, folder):
    rows = [
        ("1", "1.wav", "t", "e", "d", "p", "extra"), ("2", "2.wav", "", "e", None, "p", "extra"),
        ("3", None, "t", "e", "d", None, "extra"),
    ]
    df = spark.createDataFrame(rows, "id string, audio_path string, transcript string, english_translation string, dialect string, participant_id string, more string")
    df.write.parquet(f"{folder}/recordings")
    df.write.json(f"{folder}/recordings.json")
    for path in (f"{folder}/recordings", f"{folder}/recordings.json"):
        whole = recordings.read_recordings(spark, path)
        assert whole.columns == recordings.RECORDING_COLUMNS and whole.count() == 3
        assert [r.id for r in recordings.read_recordings(spark, path, require_complete=True).collect()] == ["1"]
    shaped = examples.recordings_to_examples(whole, cache="cache/audio")
    assert shaped.where("id = '1'").first().audio == "cache/audio/1.wav"


def test_catalog(spark, folder):
    df = spark.createDataFrame([("1", "train"), ("2", "test"), ("3", "train")], "id string, split string")
    df.write.partitionBy("split").parquet(f"{folder}/sets/demo")
    write(f"{folder}/datasets.yaml", "mt:\n  hf:\n    - demo\n    - other\nasr:\n  hf:\n    - ''\n")
    read = catalog.read_cataloged(spark, "mt", "train", f"{folder}/datasets.yaml", root=f"{folder}/sets")
    assert {str(r.id) for r in read.collect()} == {"1", "3"}
    with pytest.raises(ValueError, match="no dataset"):
        catalog.read_cataloged(spark, "asr", "train", f"{folder}/datasets.yaml")
    with pytest.raises(ValueError, match="unknown task"):
        catalog.read_cataloged(spark, "tts", "train", {"mt": {"hf": ["demo"]}})


def test_union_of_sources(spark):
    def source(name, *columns):
        return spark.createDataFrame([(name,) * len(columns)], ", ".join(f"{c} string" for c in columns))

    parts = {
        "catalog": lambda split: source("a", "id", "audio"),
        "recordings": lambda split: source("b", "id", "dialect"),
        "tree": lambda split: source("a", "id", "audio", "gender"),
    }
    train = examples.load_examples("train", **parts)
    assert sorted(r.id for r in train.collect()) == ["a", "a", "b"]
    assert set(train.columns) == {"id", "audio", "dialect", "gender"}
    assert train.where("id = 'b'").first().audio is None
    assert examples.load_examples("test", **parts).count() == 2
    with pytest.raises(ValueError, match="none of the given sources"):
        examples.load_examples("train")
    with pytest.raises(ValueError, match="none of the given sources"):
        examples.load_examples("test", recordings=parts["recordings"])
    with pytest.raises(ValueError, match="unknown kinds"):
        examples.load_examples("test", web=parts["tree"])


def test_a_speaker_with_most_of_the_rows(spark):
    names = [f"P-1-a_{i}" for i in range(90)] + [f"P-{i}-b_0" for i in range(2, 9)] + ["nobody", None]
    df = spark.createDataFrame([(n,) for n in names], "stem string")
    meta = spark.createDataFrame([("P-1-a", "d", "30", "f"), ("P-2-b", "e", "", "m")], "participant_id string, dialect string, age_group string, gender string")
    found = P.with_participants(df, meta, "stem", rows_per_task=10)
    rows = {r.stem: r for r in found.collect()}
    assert len(rows) == found.count() == len(names) and found.columns == ["stem", "participant_id", "dialect", "age_group", "gender"]
    assert all(rows[n].dialect == "d" for n in names[:90]) and rows["P-2-b_0"].age_group is None and rows["P-3-b_0"].dialect is None
    assert rows["nobody"].participant_id is None


def test_no_file_is_lost_by_its_name_or_size(spark, tmp_path):
    for name in ("a.wav", "_b.wav", ".c.wav", "empty.wav", "d e+f%.wav", "x.txt"):
        (tmp_path / name).write_bytes(b"" if name == "empty.wav" else b"x")
    (tmp_path / "folder.wav").mkdir()
    found = corpus_tree.list_files(spark, str(tmp_path), "wav").collect()
    assert {r.path.rsplit("/", 1)[1] for r in found} == {"a.wav", "_b.wav", ".c.wav", "empty.wav", "d e+f%.wav"}
    texts = {r.stem: r.text for r in corpus_tree.read_texts(spark, str(tmp_path)).collect()}
    assert texts["a"] == "x" and texts["empty"] == ""
    assert texts["_b"] == texts[".c"] == "x" and len(texts) == 6


def test_folders_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folders, "NAMES", 7)
    monkeypatch.setattr(folders, "TASK_FILES", 10)
    monkeypatch.setattr(folders, "CONTENT", 20)
    rows = [(f"{tmp_path}/{i % 3}/{'_' * (i % 2)}{i}.txt", bytes([i]) * (i % 11)) for i in range(100)]
    files = spark.createDataFrame(rows, "path string, content binary")
    assert folders.write_files(files) == folders.write_files(files) == 100
    listed = folders.list_folders(spark, [f"file://{tmp_path}/{i}" for i in range(3)])
    assert {(r.path, r.size) for r in listed.collect()} == {(p, len(c)) for p, c in rows}
    read = folders.read_files(listed)
    assert read.rdd.getNumPartitions() == 10
    assert sorted((r.path, bytes(r.content)) for r in read.collect()) == sorted(rows)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.txt").write_bytes(b" a\xff \n")
    assert corpus_tree.read_texts(spark, f"{tmp_path}/bad").first().text == "a\ufffd"
    (tmp_path / "none").mkdir()
    assert corpus_tree.read_texts(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="No such file"):
        corpus_tree.list_files(spark, f"{tmp_path}/absent").count()


def test_missing_items_and_coverage(spark):
    audio = spark.createDataFrame([("a", "a.wav"), ("a", "a.mp3"), ("b", "b.wav")], "stem string, path string")
    text = spark.createDataFrame([("a", "x"), ("c", "y")], "stem string, text string")
    assert tuple(P.coverage(audio, text).first())[:2] == (2, 3)
    assert {r.path for r in P.pair_by_stem(audio, text).collect()} == {"a.wav", "a.mp3"}
    assert [tuple(r) for r in P.pair_first_audio(text, audio).select("stem", "path").collect()] == [("a", "a.mp3")]
    cached = spark.createDataFrame([("a.wav",)], "path string")
    assert {r.path for r in P.missing_items(audio, cached, "path").collect()} == {"a.mp3", "b.wav"}
    assert P.coverage(audio.limit(0), text).first().share is None


def test_unit_files(spark, folder):
    base = f"{folder}/units"
    os.makedirs(base)
    np.save(f"{base}/one_units.npy", np.array([1, 1, 2], dtype=np.int64))
    np.save(f"{base}/two_units.npy", np.array([], dtype=np.int32))
    np.save(f"{base}/three_units.npy", np.array([5], dtype=np.int16))
    write(f"{base}/one.txt", " one text\n")
    write(f"{base}/two.txt", "two")
    rows = {r.id: r for r in units.read_units(spark, base).collect()}
    assert set(rows) == {"one", "two"} and rows["one"].units == [1, 1, 2] and rows["two"].units == []
    assert rows["one"].text == "one text" and rows["one"].file == "one_units.npy"
    kept = {r.id: r.text for r in units.read_units(spark, base, keep_unmatched=True).collect()}
    assert kept["three"] is None and len(kept) == 3


def wav(path, frames, rate, width=2):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with wave.open(path, "wb") as sound:
        sound.setnchannels(frames.shape[1])
        sound.setsampwidth(width)
        sound.setframerate(rate)
        scaled = np.clip(np.round(frames * (1 << (8 * width - 1))), -(1 << (8 * width - 1)), (1 << (8 * width - 1)) - 1)
        if width == 1:
            sound.writeframes((scaled + 128).astype(np.uint8).tobytes())
        else:
            sound.writeframes(scaled.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes())


def tone(rate, seconds=0.5, hertz=440.0):
    return 0.5 * np.sin(2 * np.pi * hertz * np.arange(int(rate * seconds)) / rate)


def test_audio(spark, folder):
    base = f"{folder}/audio"
    wav(f"{base}/same.wav", tone(16000)[:, None], 16000)
    wav(f"{base}/stereo.wav", np.stack([tone(44100), tone(44100)], 1), 44100)
    wav(f"{base}/low.wav", tone(8000)[:, None], 8000, width=1)
    wav(f"{base}/deep.wav", tone(16000)[:, None], 16000, width=3)
    write(f"{base}/broken.wav", b"RIFFnothing")
    write(f"{base}/other.txt", "ignored")
    rows = {r.id: r for r in A.read_audio(spark, base).collect()}
    assert set(rows) == {"same", "stereo", "low", "deep", "broken"}
    assert rows["broken"].samples is None and rows["broken"].error
    want = tone(16000)
    assert np.abs(np.array(rows["same"].samples) - want).max() < 1e-4
    assert np.abs(np.array(rows["deep"].samples) - want).max() < 1e-6
    for name, rate, channels, slack in (("stereo", 44100, 2, 2e-3), ("low", 8000, 1, 2e-2)):
        r = rows[name]
        assert (r.rate, r.n, r.rate_in, r.channels_in, r.error) == (16000, 8000, rate, channels, None)
        middle = slice(200, -200)
        assert np.abs(np.array(r.samples)[middle] - want[middle]).max() < slack


def test_audio_predicates(spark):
    from paracorpus.functions import sequences as S

    df = spark.createDataFrame([(16000, 1, 8000), (44100, 2, 16000)], "rate int, ch int, n int")
    row = [tuple(r) for r in df.select(S.needs_resample("rate"), S.needs_downmix("ch"), S.seconds("n")).collect()]
    assert row == [(False, False, 0.5), (True, True, 1.0)]


def test_examples_conform(spark):
    df = spark.createDataFrame([(7, "p")], "key int, path string")
    out = P.to_examples(df, {"id": "key", "audio": F.concat(F.lit("x/"), "path")}).first()
    assert out.id == "7" and out.audio == "x/p" and out.gender is None
    assert [r.path for r in P.non_empty(spark.createDataFrame([("a",), ("  ",), (None,)], "path string"), "path").collect()] == ["a"]


def test_a_cache_is_filled_once(spark, tmp_path):
    notes, folder = tmp_path / "seen", str(tmp_path / "cache")

    def convert(broken=False):
        def run(batches):
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    with open(notes, "a") as file:
                        file.write(f"{path}\n")
                    if broken and path == "p7":
                        raise OSError("half way")
                yield batch

        return lambda df: df.select("path").mapInArrow(run, "path string").selectExpr("path", "upper(path) as made")

    def manifest(n):
        return spark.createDataFrame([(f"p{i}",) for i in range(n)] + [("p1",), (None,)], "path string").repartition(3)

    def seen():
        return len(notes.read_text().split())

    with pytest.raises(Exception, match="half way"):
        cache.fill_cache(manifest(20), folder, convert(broken=True))
    assert cache.read_cache(spark, folder, "path string, made string").count() == 0
    notes.write_text("")
    filled = cache.fill_cache(manifest(20), folder, convert())
    assert sorted(map(tuple, filled.collect())) == sorted((f"p{i}", f"P{i}") for i in range(20)) and seen() == 20
    assert cache.fill_cache(manifest(20), folder, convert()).count() == 20 and seen() == 20
    assert cache.fill_cache(manifest(25), folder, convert()).count() == 25 and seen() == 25
    assert cache.fill_cache(manifest(0).where("path is null"), f"{folder}2", convert()).count() == 0


def write_wav(path, rate, channels, width, frames):
    with wave.open(str(path), "wb") as sound:
        sound.setnchannels(channels)
        sound.setsampwidth(width)
        sound.setframerate(rate)
        sound.writeframes(frames)


@pytest.mark.parametrize("piece", [700, 5000, 10**6])
def test_long_recordings_are_conformed_in_pieces(spark, tmp_path, piece):
    rnd = np.random.default_rng(1)
    for i, (rate, channels, width, n) in enumerate([(8000, 2, 2, 9000), (44100, 1, 2, 20001), (16000, 1, 1, 3000), (16000, 2, 4, 1), (11025, 1, 3, 0), (22050, 1, 2, 5)]):
        write_wav(tmp_path / f"r{i}.wav", rate, channels, width, rnd.integers(0, 256, n * channels * width, dtype=np.uint8).tobytes())
    (tmp_path / "broken.wav").write_bytes(b"RIFF nothing")
    (tmp_path / "empty.wav").write_bytes(b"")
    whole = {r.id: r for r in A.read_audio(spark, str(tmp_path)).collect()}
    files = folders.list_folders(spark, [str(tmp_path)])
    rows = A.conform_in_pieces(files, piece_samples=piece).collect()
    assert set(whole) | {"empty"} == {r.id for r in rows}
    for name, want in whole.items():
        parts = sorted((r for r in rows if r.id == name), key=lambda r: r["first"])
        assert [r.piece for r in parts] == list(range(len(parts)))
        if want.error:
            assert len(parts) == 1 and parts[0].error and parts[0].samples is None
            continue
        assert [x for r in parts for x in r.samples] == want.samples
        assert {(r.rate, r.n, r.channels_in, r.rate_in) for r in parts} == {(want.rate, want.n, want.channels_in, want.rate_in)}
        assert len(parts) == max(1, -(-want.n // piece)) and all(len(r.samples) <= piece for r in parts)


def test_a_folder_is_made_once_and_empty_files_are_not_renamed(tmp_path, monkeypatch):
    made, asked, renamed = set(), [], []
    makedirs, replace = os.makedirs, os.replace
    monkeypatch.setattr(os, "makedirs", lambda path, **k: asked.append(path) or makedirs(path, **k))
    monkeypatch.setattr(os, "replace", lambda a, b: renamed.append(b) or replace(a, b))
    for i in range(20):
        folders.write_file(f"{tmp_path}/a/{i}", b"x" * i * 100_000, made)
    folders.write_file(f"{tmp_path}/a/3", b"", made)  # once more, now empty
    assert asked == [f"{tmp_path}/a"] and len(renamed) == 19
    assert [os.path.getsize(f"{tmp_path}/a/{i}") for i in range(20)] == [0 if i == 3 else i * 100_000 for i in range(20)]
    assert len(os.listdir(tmp_path / "a")) == 20
