"""Prompts, choice of parts, tokenisers, models and configuration."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant import config
from foliant.operators import dialogue, models, podcast
from foliant.sources import pages


def test_long_scripts_are_divided(spark):
    text = "🎙" * 200_000 + "[S2] b [PAUSE_SHORT] c"
    got = dialogue.turns(spark.createDataFrame([(1, text)], "doc_id long, dialogue string")).orderBy("turn_idx").collect()
    assert [(r.tag, len(r.text)) for r in got] == [("S1", 200_000), ("S2", 1), ("PAUSE", 13), ("S2", 1)]
    parts = dialogue.narration_parts(spark.createDataFrame([(1, " a [PAUSE_LONG] [S1] b [PAUSE_OTHER]")], "doc_id long, narration string")).orderBy("part_idx").collect()
    assert [(r.kind, r.text) for r in parts] == [("text", "a"), ("pause", "[PAUSE_LONG]"), ("text", "[S1] b [PAUSE_OTHER]")]


def test_choice_of_parts(spark):
    chosen = lambda v, n=5: sorted(r.idx for r in podcast.selected(spark.createDataFrame([(v, n)], "value string, total int")).collect())
    assert chosen("intro,outro") == [0, 4]
    assert chosen("1-3, 2") == [1, 2, 3]
    assert chosen("3-1") == [] and chosen("7") == [] and chosen("3-99") == [3, 4]
    for bad in ("x", "1-b", "-1"):
        with pytest.raises(Exception, match="not a part"):
            chosen(bad)


def test_speakers(spark):
    one = spark.range(1)
    with pytest.raises(Exception, match="two voices"):
        one.select(*podcast.speakers(F.array(F.lit("af")), F.lit(1.0), F.lit(None).cast("array<double>")).values()).collect()
    assert one.select(podcast.mismatched(F.array(F.lit("zz")), F.lit("xx"))).first()[0] == []


def server(answers):
    """A server that gives each answer once, and what it has been sent."""
    sent, left = [], list(answers)

    def send(url, body, timeout):
        if url.endswith("/api/tags"):
            return 200, json.dumps({"models": [{"name": "m:7b"}]}).encode()
        sent.append(json.loads(body))
        x = left.pop(0)
        if isinstance(x, Exception):
            raise x
        return x if isinstance(x, tuple) else (200, json.dumps({"response": x}).encode())

    return send, sent


def test_http_model():
    waits = []
    send, sent = server([OSError("down"), (503, b"busy"), "<think>a\nb</think> yes"])
    model = models.http_model("u", "m", {"top_k": None, "temperature": 0.3}, send=send, wait=waits.append)()
    assert model("s", "p") == "yes" and waits == [4, 16]
    assert sent[0] == {"model": "m", "system": "s", "prompt": "p", "stream": False, "options": {"temperature": 0.3}}
    send, sent = server([(404, b"no"), "x"])
    with pytest.raises(models.Unavailable):
        models.http_model("u", "m", send=send, wait=waits.append)()("s", "p")
    assert len(sent) == 1  # refused at once
    with pytest.raises(models.Unavailable, match="after 3 attempts"):
        models.http_model("u", "m", send=server([OSError()] * 3)[0], wait=waits.append)()("s", "p")
    with pytest.raises(models.Unavailable, match="isn't among"):
        models.http_model("u", "other", send=send)()


def test_generated(spark):
    rows = spark.createDataFrame([(1, "s", "p"), (2, None, "q"), (3, "s", None)], "id long, system string, prompt string")
    got = {r.id: r.answer for r in models.generated(rows, lambda: lambda s, p: f"{s}/{p}").collect()}
    assert got == {1: "s/p", 2: "/q", 3: None}


def test_model_list(spark):
    df = spark.createDataFrame([('{"models":[{"name":"a"},{"name":"b:1"}]}',), ("<html>",), (None,)], "body string")
    assert [r[0] for r in df.select(models.model_names(F.col("body"))).collect()] == [["a", "b:1"], [], []]


def test_wav():
    import io
    import wave

    with wave.open(io.BytesIO(models.wav(np.array([0, 1, -1], np.float32)))) as w:
        assert (w.getnframes(), w.getframerate(), w.getnchannels()) == (3, 24_000, 1)


def counted(limit_mb):
    """A speech model of ones, which fails when its worker holds more than limit_mb beyond what it held at first."""
    import resource

    def speak(text, voice, speed):
        now = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
        speak.first = getattr(speak, "first", now)
        if now - speak.first > limit_mb:
            raise MemoryError(f"{now - speak.first:.0f} MB more")
        return np.ones(len(text.split()) * 9600, np.float32)

    return speak


def spoken_turns(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, turn_idx long, tag string, text string").withColumns({"voice": F.lit("v"), "speed": F.lit(1.0)}).coalesce(1)


def test_rendered_leaves_few_at_a_time(spark):
    t = spoken_turns(spark, [(1, i, "S1", "a " * 200) for i in range(120)] + [(1, 120, "PAUSE", "[PAUSE_LONG]")])  # half a GB of files
    got = models.rendered(t, counted(150), 10).select("turn_idx", "n_samples", F.length("wav").alias("n"), F.substring("wav", 45, 2).alias("s")).collect()
    assert sorted(map(tuple, got)) == [(i, 1920010, 44 + 2 * 1920010, b"\xff\x7f") for i in range(120)] + [(120, 48000, 96044, b"\0\0")]


def test_final_wav_in_pieces(spark):
    import io
    import wave

    t = spoken_turns(spark, [(k, i, "S1", "a " * (20 * k)) for k in (2, 1) for i in (2, 0)] + [(1, 1, "PAUSE", "[PAUSE_SHORT]"), (3, 0, "S2", "")])
    rows = models.final_wav(t, "doc_id", "turn_idx", 5, counted(1000), 3).collect()
    for k, turns in {1: [192000, None, 192000], 2: [384000, 384000], 3: [0]}.items():
        mine = sorted((r.piece, r.n_samples, bytes(r.wav)) for r in rows if r.doc_id == k)
        assert [p for p, _, _ in mine] == list(range(len(mine))) and max(len(x) for _, _, x in mine) <= 2 * models.PIECE
        body = (b"\0\0" * 5).join(b"\0\0" * 12000 if n is None else b"\xff\x7f" * n + b"\0\0" * 3 for n in turns)
        with wave.open(io.BytesIO(b"".join(x for _, _, x in mine))) as w:
            assert (w.getnframes(), w.readframes(10**7)) == (sum(n for _, n, _ in mine), body)
    long = spoken_turns(spark, [(1, i, "S1", "a " * 200) for i in range(120)])
    assert models.final_wav(long, "doc_id", "turn_idx", 0, counted(150), 0).agg(F.sum("n_samples"), F.sum(F.length("wav"))).first()[:] == (120 * 1920000, 44 + 240 * 1920000)


def test_configuration(tmp_path):
    (tmp_path / "e.yaml").write_text("")
    assert config.load_file(str(tmp_path / "e.yaml")) == {}
    assert config.build_llm({"model": "x"}, {"x": 8000}).num_ctx == 8000
    assert config.build_llm({"model": "x", "num_ctx": 9}, {"x": 8000}).num_ctx == 9
    with pytest.raises(ValueError):
        config.build_llm({"backend": "no"})
    with pytest.raises(ValueError):
        config.build_tts({"backend": "no"})
    run = config.build_run("podcast", {"dialogue": {"target_lang": "fr"}}, {"y": 4000})
    assert (run.max_toc_level, run.context_budget, run.llm.temperature) == (1, 20_305, 0.7)
    assert run.tts.voices == ("ff_siwis", "ff_siwis") and run.tts.speeds == (0.95, 0.95 * 1.08)
    args = config.parser("podcast").parse_args(["--target-lang", "es", "--model", "y", "--duration", "30", "--voice2", "em_alex"])
    run = config.override(run, args, {"y": 4000})
    assert run.tts.voices == ("ef_dora", "em_alex") and run.llm.num_ctx == 4000 and run.context_budget == 20_305
    assert run.text.target_duration_min == 30
    assert config.build_run("audiobook", {}).llm.temperature == 0.3
    assert config.PresetVoices(voices=("ef_dora",)).lang == "es"
    assert config.context_budget(config.LocalModel()) == 20_305


def test_runtime():
    assert config.speech_runtime({"TTS_RUNTIME": " MLX "}) == "mlx"
    assert config.speech_runtime({}) in ("mlx", "torch")
    with pytest.raises(ValueError):
        config.speech_runtime({"TTS_RUNTIME": "cuda"})


def test_tee(tmp_path):
    import io

    out = io.StringIO()
    tee = config.Tee(str(tmp_path / "log"), out)
    print("line", file=tee)
    tee.flush()
    assert out.getvalue() == (tmp_path / "log").read_text() == "line\n"


def test_page_tables_links_images():
    html = "<h2>T</h2><p>See <a href='u'>this</a> <img src='x' alt='y'></p><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>"
    assert pages.page_markdown(html) == "## T\n\nSee this\n\n| a | b |\n|---|---|\n| 1 | 2 |"


def test_prompts():
    from foliant import prompts

    for name in ("outline", "intro", "outro", "summary", *prompts.BLOCKS.values(), *prompts.DIALOGUES.values()):
        text = prompts.prompt(name)
        assert text and text == text.strip()
    assert "{target_words}" in prompts.prompt("two_hosts")


def test_file_backends(spark, tmp_path):
    from foliant.sources import files

    (tmp_path / "a.pdf").write_bytes(b"A")
    (tmp_path / "b.pdf").write_bytes(b"bad")
    (tmp_path / "c.txt").write_bytes(b"no")

    def make():
        def convert(data, pages):
            if data == b"bad":
                raise RuntimeError("broken")
            return f"# {data.decode()} {pages}"

        return convert

    found = files.read_files(spark, str(tmp_path))
    got = sorted((r.path[-5:], r.markdown, r.error) for r in files.to_markdown(found, "own", {"own": make}).collect())
    assert got == [("a.pdf", "# A None", None), ("b.pdf", None, "RuntimeError: broken")]
    some = found.where("path like '%a.pdf'").withColumn("pages", F.array(F.lit(2)))
    assert files.to_markdown(some, "own", {"own": make}).first().markdown == "# A [2]"
    with pytest.raises(ValueError, match="unknown backend"):
        files.to_markdown(found, "none")


def test_web_sections(spark):
    from foliant.operators import extract

    rows = [(1, "u", "<h1>A</h1><p>a</p><h2>B</h2><p>b</p>"), (2, "v", None), (3, "w", "<p>only</p>")]
    got = sorted(map(tuple, extract.web_sections(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()))
    assert got == [(1, 0, "A", "a\n\n## B\n\nb"), (3, 0, "Full article", "only")]
