"""Settings from files and the environment."""

import json

import pytest

from quillmark import config


def test_load(tmp_path):
    path = tmp_path / "run.yaml"
    path.write_text(json.dumps({"output": "out", "limits": {"max_pages": 3}, "points": {"pdf_editor": 4}, "recognition": {"url": "http://x"}}))
    c = config.load(str(path), {"QUILLMARK_LIMITS_MAX_PAGES": "7", "QUILLMARK_EXTRACTION_URL": "http://y", "QUILLMARK_RECURSIVE": "no"})
    assert c.output == str(tmp_path / "out") and c.limits.max_pages == 7 and c.points.pdf_editor == 4.0
    assert c.extraction.enabled and c.extraction.url == "http://y" and not c.recognition.enabled and not c.recursive
    assert config.session_conf(c)["quillmark.limits.max_pages"] == "7" and config.load(None, {}) == config.Config()


@pytest.mark.parametrize("values", [{"other": 1}, {"limits": {"max_pages": "3"}}, {"limits": {"max_pages": True}}, {"limits": 3}, {"limits": {"max_pages": -1}}, {"recursive": 1}])
def test_refused(tmp_path, values):
    path = tmp_path / "run.json"
    path.write_text(json.dumps(values))
    with pytest.raises(config.ConfigError):
        config.load(str(path), {})
    with pytest.raises(config.ConfigError):
        config.load(None, {"QUILLMARK_RECURSIVE": "maybe"})
