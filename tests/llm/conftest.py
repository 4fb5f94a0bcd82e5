import pytest

from loomtext.llm import attention_lm


@pytest.fixture(scope="session")
def codec_args():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture
def quick_model(monkeypatch):
    monkeypatch.setattr(attention_lm, "SAMPLE_WINDOWS", 600)
