import json

import pytest

from lorekeep.functions.secrets import holds_secret

HELD = [
    '{"accessToken": "x"}', '{"id_token": 1}', '{"a": {"JWT": "x"}}', '{"list": [{"Session-Token": "x"}]}', '{"credentials": null}', '{"X-Amz-Security-Token": "x"}',
    "https://host/p?X-Amz-Credential=abc", "see https://blob/c?sv=2020&se=2021 now", "//host/p?sig=abc", r"https:\\host\p?sig=abc", "https:/host/p?code=1", "/relative?access_token=abc", "[text](/a?key=1)",
    "https://user@host/x", "https://user:pw@host/x", "<a href='https://h/?a=1&amp;signature=2'>", "https://h/#/route?token=1", "https://h/#access_token=abc",
    "https://h/?next=https%3A%2F%2Fo%2Fp%3Fsig%3D1", "https://h/?next=%252Fp%253Fjwt%253D1", "https://h/?state=" + "%7B%22client_secret%22%3A1%7D", "https://h/?q=token:abc",
    "password: hunter2", "x\n  api-key = 5", "[cookie: a=b]", "Authorization: Bearer abc", "auth=Basic abc", "client.secret=x", json.dumps({"text": json.dumps({"private_key": "x"})}), "&amp;#112;assword=x"[5:].replace("#112;", "&#112;", 1),
]
CLEAN = [
    "the token was discussed", "a password policy: none set"[2:10], "https://host/path?page=2&sort=asc", "https://host/#section", "//comment about the code", "authorization: pending", "keynote = speech", '{"title": "secretary", "tokens": 3}',
    "mail me at user@host", "https://h/?next=https%3A%2F%2Fo%2Fp%3Fpage%3D1", "ratio 3:4 and key: value", "", None,
]


@pytest.mark.parametrize("text", HELD)
def test_held(text):
    assert holds_secret(text)


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    assert not holds_secret(text)


def test_nesting_beyond_the_limit_is_refused():
    text = "https://h/?page=1"
    for _ in range(12):
        text = "https://h/?next=" + text.replace("%", "%25").replace("?", "%3F").replace("=", "%3D").replace("&", "%26")
    assert holds_secret(text)
