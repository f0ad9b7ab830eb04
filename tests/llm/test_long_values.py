import base64
import random

from sievework.llm import secrets


def test_a_long_value_is_a_secret():
    value = "abcdefghijklmno!" + base64.b64encode(random.Random(5).randbytes(4500)).decode()
    text = f'key_store_password = "{value}"'
    found = secrets.find(text, "py")
    assert len(found) == 1 and value not in secrets.redact(text, found)
