"""The pipeline on a small corpus, stage by stage against brute force; the entry without it."""

import os
import random
import shutil
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from barline.llm import line_dedup, mixing
from barline.llm import sentencepiece_codec as codec
from barline.llm.common import keep_table
from test_exact_and_lines import brute_lines
from test_similarity import brute_groups
from test_texts import corpus

REPO = Path(__file__).resolve().parents[2]


def small_corpus(spark, folder):
    rng, docs, labels = random.Random(11), [], []
    words = [f"{a}{b}ing" for a in "bcdfghk" for b in "aeiou"]
    shared = " ".join(rng.choice(words) for _ in range(12))
    for i, text, label in corpus(300, 4):
        labels.append((i, label, 0))
        if label:
            lines = [" ".join(rng.choice(words) for _ in range(rng.randint(6, 14))) for _ in range(4)]
            if rng.random() < 0.3:
                lines.insert(rng.randrange(5), shared + rng.choice(["", "", "x"]))
            if docs and rng.random() < 0.2:
                lines = rng.choice([d for d in docs])[1].split("\n")
                near = lines[0].split(" ")
                if rng.random() < 0.6:
                    near[rng.randrange(len(near))] = "changed"
                lines[0] = " ".join(near)
            text = "\n".join(lines)
        docs.append((i, text, "en", f"s{i % 4}" if i % 9 else None, len(text)))
    docs += [(900, None, "en", "s1", 0), (901, "", None, "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, dict((i, y) for i, y, _ in labels)


def test_stages_match_brute_force(spark, tmp_path):
    docs, label = small_corpus(spark, tmp_path)
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = now.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        now = keep_table(stage(spark, now, str(tmp_path)), f"test-{name}")
        seen[name] = now
        assert name == "encode" or now.columns == columns
    text = {name: sorted((r.doc_id, r.text) for r in df.collect()) if name != "encode" else None for name, df in seen.items()}

    kept = {i for i, _ in text["quality"]}
    assert sum((i in kept) == bool(y) for i, y in label.items()) >= 0.9 * len(label)  # 240 rows to learn from
    assert text["quality"] == sorted((i, t) for i, t, *_ in docs if i in kept)

    cut = brute_lines(text["quality"], line_dedup.MAX_EDITS, line_dedup.MIN_CHARS)
    want = []
    for i, t in text["quality"]:
        lines = (t or "").split("\n")
        left = [x for k, x in enumerate(lines) if k not in cut[i][0]]
        if not cut[i][0] or any(len(x.strip()) >= line_dedup.MIN_CHARS for x in left):
            want.append((i, "\n".join(left) if cut[i][0] else t))
    assert text["line_dedup"] == want and len(want) < len(text["quality"])
    assert all(r.n_chars == len(r.text or "") for r in seen["line_dedup"].collect())

    groups = brute_groups(text["line_dedup"])
    assert [i for i, _ in text["near_dedup"]] == [i for i, _, c in groups if i == c]

    copies = {r.doc_id: r.n_copies for r in mixing.mix(seen["near_dedup"]).collect()}
    assert text["mix"] == sorted((i, t) for i, t in text["near_dedup"] for _ in range(copies[i]))
    assert sum(copies.values()) > 0

    coded = seen["encode"]
    assert sorted(r.doc_id for r in coded.collect()) == [i for i, _ in text["mix"]]
    assert sorted(tuple(r) for r in codec.decode(coded).collect()) == text["mix"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(text["mix"])


def test_short_lines_of_its_own_keep_a_document(spark, frame):
    footer = "a footer line that every document carries"
    docs = frame([(1, footer, "s"), (2, f"for x in y:\n  {footer}\n  go(x)", "s"), (3, f"--\n{footer}\n \n***", "s"), (4, f"é\n{footer}", "s"), (5, "--", "s"), (6, None, "s"), (7, f"漢字\n{footer}", "s")])
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert got == {1: footer, 2: "for x in y:\n  go(x)", 4: "é", 5: "--", 6: None, 7: "漢字"}


def test_entry_works_without_the_text_operators(tmp_path):
    for name in ("barline", "__spark_entry__.py", "corpus_pipeline.py"):
        source = REPO / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(k.startswith('op') for k in q), set(e.oracle_sql()) <= set(q))"

    def run():
        env = {**os.environ, "PYTHONPATH": str(tmp_path)}
        out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
        assert out.returncode == 0, out.stderr[-2000:]
        return out.stdout.split()[-4:]

    assert run()[1:] == ["True", "True", "True"]
    shutil.rmtree(tmp_path / "barline" / "llm")
    (tmp_path / "corpus_pipeline.py").unlink()
    n, *rest = run()
    assert int(n) > 300 and rest == ["False", "False", "True"]
