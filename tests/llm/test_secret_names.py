"""Assignment forms of the secret scan."""

import pytest

from rivulet.llm import secret_scan


def found(text):
    return [text[s:e] for s, e, _ in secret_scan.literal_spans(text)]


@pytest.mark.parametrize("target", [
    'cfg["client_secret"] =', "config['db_password'] =", 'os.environ["DB_PWD"] =', 'cfg["db"]["client_secret"] =', 'cfg[ "client_secret" ] =', 'cfg["client_secret"][0] =',
    "api_token: str =", "dbPassword: string =", "val password: String =", "api_token: Optional[str] =", "api_token: str | None =", "apiToken?: string =",
    "const API_TOKEN: &'static str =", "password: String? =", 'cfg["api_token"]: str =', "if ready: api_token =", "client_secret =", '"client_secret":',
])
def test_target_names(target):
    assert found(f'x = 1\n{target} "x9$kLm2Qw7"\n') == ["x9$kLm2Qw7"]


@pytest.mark.parametrize("text", ['label: str = "x9$kLm2Qw7"', 'cfg["label"] = "x9$kLm2Qw7"', 'cfg["password"] == "x9$kLm2Qw7"', 'label: str = "x9$kLm2Qw7"\napi_token: str\n'])
def test_other_names(text):
    assert found(text) == []


def test_constants_with_types_propagate():
    assert found('base: str = "x9$kLm2Qw7"\ncfg["client_secret"] = base\n') == ["x9$kLm2Qw7"]
    assert found('if old: base = "x9$kLm2Qw7"\nclient_secret = base\n') == ["x9$kLm2Qw7"]


@pytest.mark.parametrize("text", [
    "x" * 300 + '_password: "x9$kLm2Qw7"', "api_password" + " " * 400 + '= "x9$kLm2Qw7"', '{"a": {"db_password" : "x9$kLm2Qw7"}}', "db_password: x9$kLm2Qw7 # note", "client_secret:\n", "<db-password>x9$kLm2Qw7</db-password>",
    "client_secret: |\n  x9$kLm\n  2Qw7yZ\nother: 1", 'secret = SecretStr("x9$kLm2Qw7")', 'pwd = os.environ.get("DB_PWD", "x9$kLm2Qw7")', '- name: DB_PASSWORD\n  value: "x9$kLm2Qw7"', 'client_secret = base\nbase = "x9$kLm2Qw7"\n',
    '# password = "x9$kLm2Qw7"', 'client_secret = wrap(\n    "x9$kLm2Qw7"\n)', 'ssh_key = "aG9uZXN0bHkgbm90aGluZyB0byBzZWU9/9x+Zk3"',
])
def test_forms_of_values(text):
    want = {"client_secret:\n": [], "client_secret: |\n  x9$kLm\n  2Qw7yZ\nother: 1": ["x9$kLm\n  2Qw7yZ"]}
    last = "aG9uZXN0bHkgbm90aGluZyB0byBzZWU9/9x+Zk3"
    got = found(text)
    assert got == (want[text] if text in want else [last] if last in text else ["x9$kLm2Qw7"])


def test_parts_and_cycles():
    assert found('base = "x9$kLm"\nclient_secret = base + "2Qw7#zz"\n') == ["x9$kLm", "2Qw7#zz"]
    assert found('client_secret = "x9$kL" + "m2Qw7"') == ['x9$kL" + "m2Qw7']
    assert found("secret_a = secret_b\nsecret_b = secret_a\n") == []
    assert found("if password == 'x9$kLm2Qw7': pass\nit's a token: don't\n") == []
    assert found('key_name = "label"\n// url = http://a.b/c\nlabel = "x9$kLm2Qw7"\n') == []


def test_long_texts_take_linear_time():
    import time

    began = time.time()
    for text in ("password" * 50_000, "a = b\n" * 50_000 + "key", "key[" * 50_000, "token:" * 50_000, "'key" * 50_000, "key = f(" * 20_000):
        secret_scan.literal_spans(text)
    assert time.time() - began < 60
