"""Validation scores every page of the held-out hosts, whatever the bound of the fitting sample."""

from quarrylight.llm import residue as R


def test_all_held_out_pages(monkeypatch, spark):
    monkeypatch.setattr(R, "MAX_PAGES", 20)
    monkeypatch.setattr(R, "STEPS", 20)
    hosts = [f"host{i}.org" for i in range(60)]
    word = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    rows = [(str(i), f"the bridge {word(i)} was opened on monday.\nlorem ipsum {word(i)} sitar", "A title", h) for i, h in enumerate(hosts)]
    got = R.validation(spark.createDataFrame(rows, "article_id string, article_text string, title string, domain string")).first()
    held = sum(R.host_part(h) == 0 for h in hosts)
    assert (got.hosts, got.sentences, got.positives) == (held, 2 * held, held)
