"""Signatures of XISF units: one that holds, and everything that must not."""

import base64
import hashlib
import random
import xml.etree.ElementTree as ET

import pytest

from skylattice.errors import XisfSignatureError
from skylattice.formats import xisf

DSIG = "http://www.w3.org/2000/09/xmldsig#"
EXCLUSIVE = "http://www.w3.org/2001/10/xml-exc-c14n#"


def prime(bits, r):
    while True:
        n = r.getrandbits(bits) | 1 | 3 << bits - 2
        if all(pow(a, n - 1, n) == 1 for a in (2, 3, 5, 7, 11, 13)) and n % 65537 != 1:
            return n


@pytest.fixture(scope="module")
def key():
    r = random.Random(5)
    p, q = prime(520, r), prime(520, r)
    return p * q, 65537, pow(65537, -1, (p - 1) * (q - 1))


def signed(key, unit="<Property id='a' type='Int32' value='5'/>", padding=None, uri="", form=EXCLUSIVE, prefix="", info_extra="", digest_of=None):
    n, e, d = key
    b64 = lambda x: base64.b64encode(x).decode()
    long = lambda x: b64(x.to_bytes((x.bit_length() + 7) // 8, "big"))
    head, tail = f'<xisf version="1.0" xmlns="{xisf.NAMESPACE}"{prefix}>{unit}', "</xisf>"
    digest = b64(hashlib.sha256(ET.canonicalize(digest_of or head + tail).encode()).digest())
    info = (
        f'<SignedInfo><CanonicalizationMethod Algorithm="{form}"/><SignatureMethod Algorithm="http://www.w3.org/2001/04/xmldsig-more#rsa-sha256"/><Reference URI="{uri}"><Transforms>'
        f'<Transform Algorithm="{DSIG}enveloped-signature"/><Transform Algorithm="{EXCLUSIVE}"/></Transforms><DigestMethod Algorithm="http://www.w3.org/2001/04/xmlenc#sha256"/>'
        f"<DigestValue>{digest}</DigestValue></Reference>{info_extra}</SignedInfo>"
    )
    canonical = ET.canonicalize(info.replace("<SignedInfo", f'<SignedInfo xmlns="{DSIG}"', 1))
    size = (n.bit_length() + 7) // 8
    block = xisf._DIGESTS["sha256"] + hashlib.sha256(canonical.encode()).digest()
    block = padding(block, size) if padding else b"\0\1" + b"\xff" * (size - len(block) - 3) + b"\0" + block
    value = b64(pow(int.from_bytes(block, "big"), d, n).to_bytes(size, "big"))
    keys = f"<KeyInfo><KeyValue><RSAKeyValue><Modulus>{long(n)}</Modulus><Exponent>{long(e)}</Exponent></RSAKeyValue></KeyValue></KeyInfo>"
    return f'{head}<Signature xmlns="{DSIG}">{info}<SignatureValue>{value}</SignatureValue>{keys}</Signature>{tail}'


def test_a_signature_holds_and_changes_break_it(key):
    text = signed(key)
    assert xisf.check_signature(text) is None and xisf.check_signature(text, key[:2]) is None
    assert xisf.read(text.encode()).properties[0].value == 5
    changed = text.replace("value='5'", "value='6'")
    assert xisf.check_signature(changed) == "digest differs"
    with pytest.raises(XisfSignatureError):
        xisf.read(changed.encode())
    assert xisf.read(changed.encode(), signature_policy="warn").warnings == [("SIGNATURE", "digest differs")]
    assert xisf.read(changed.encode(), signature_policy="ignore").properties[0].value == 6
    assert xisf.check_signature("<xisf version='1.0'/>") == "no signature"


def test_names_with_a_prefix_stay_as_they_are(key):
    text = signed(key, unit="<x:note xmlns:x='urn:x' x:a='1'/><Property id='a' type='Int32' value='5'/>")
    assert xisf.check_signature(text) is None
    assert xisf.check_signature(text.replace("x:a='1'", "x:a='2'")) == "digest differs"


def test_another_key_or_value_does_not_hold(key):
    text = signed(key)
    assert xisf.check_signature(text, (key[0] + 2, 65537)) == "signature differs"
    at = text.index("<SignatureValue>") + 20
    assert xisf.check_signature(text[:at] + ("A" if text[at] != "A" else "B") + text[at + 1 :]) == "signature differs"
    assert xisf.check_signature(text.replace("rsa-sha256", "rsa-sha512")) == "signature differs"


@pytest.mark.parametrize(
    "padding",
    [
        lambda block, size: b"\0\1" + bytes(size - len(block) - 2) + block,  # zeros for FF
        lambda block, size: b"\0\1\xff\0" + b"x" * (size - 36) + block[-32:],  # a digest at the end of anything
        lambda block, size: b"\0\1" + b"\xff" * 8 + b"\0" + block + b"x" * (size - len(block) - 11),  # and anything after it
        lambda block, size: b"\0\2" + b"\xff" * (size - len(block) - 3) + b"\0" + block,
        lambda block, size: b"\0\1" + b"\xff" * (size - 35) + b"\0" + block[-32:],  # without the algorithm's name
    ],
)
def test_padding_is_compared_whole(key, padding):
    assert xisf.check_signature(signed(key, padding=padding)) == "signature differs"


def test_what_is_not_the_whole_document_is_refused(key):
    assert xisf.check_signature(signed(key, uri="#a")) == "unsupported reference"
    twice = "<Reference URI=''><DigestMethod Algorithm='x#sha256'/><DigestValue/></Reference>"
    assert xisf.check_signature(signed(key, info_extra=twice)).startswith("unsupported")
    assert xisf.check_signature(signed(key, form="http://www.w3.org/TR/1999/REC-xpath")) == "unsupported transform"
    inclusive = "http://www.w3.org/TR/2001/REC-xml-c14n-20010315"
    assert xisf.check_signature(signed(key, form=inclusive)) is None
    assert xisf.check_signature(signed(key, form=inclusive, prefix=" xmlns:y='urn:y'")) == "unsupported name prefixes"
    text = signed(key)
    inner = text[text.index("<Signature ") : text.index("</xisf>")]
    assert xisf.check_signature(text.replace(inner, f"<Metadata>{inner}</Metadata>")) == "unsupported place of a signature"
    assert xisf.check_signature(text.replace("</xisf>", inner + "</xisf>")) == "unsupported place of a signature"
    none = signed(key).split("<KeyInfo>")[0] + "</Signature></xisf>"
    assert xisf.check_signature(none) == "unsupported key" and xisf.check_signature(none, key[:2]) is None


def test_descriptive_elements_are_checked():
    from skylattice.errors import XisfValidationError

    image = lambda **elements: xisf.write(xisf.Unit(images=[xisf.Image([2, 2, 1], "UInt8", data=b"abcd", elements=elements)]))
    good = {"Resolution": {"horizontal": 96.0, "vertical": 96.0, "unit": "m"}, "ColorFilterArray": {"pattern": "RGGB", "width": 2, "height": 2}, "ICCProfile": {"data": b"\1\2"}}
    found = xisf.read(image(**good)).images[0].elements
    assert found["Resolution"]["unit"] == "inch" and found["ColorFilterArray"]["width"] == 2 and found["ICCProfile"]["data"] == b"\1\2"
    for bad in (
        {"Resolution": {"horizontal": 0.0}}, {"Resolution": {"vertical": "wide"}}, {"ColorFilterArray": {"pattern": "RGGX", "width": 2, "height": 2}},
        {"ColorFilterArray": {"pattern": "RGG", "width": 2, "height": 2}}, {"ColorFilterArray": {"pattern": "", "width": 0, "height": 0}}, {"DisplayFunction": {"m": [1.0, 2.0]}},
    ):
        with pytest.raises(XisfValidationError):
            xisf.read(image(**bad))
    small = xisf.Image([1, 1, 1], "UInt8", data=b"x")
    unit = xisf.Unit(images=[xisf.Image([2, 2, 1], "UInt8", data=b"abcd", thumbnail=small)])
    assert xisf.read(xisf.write(unit)).images[0].thumbnail.data == b"x"
    small.thumbnail = small2 = xisf.Image([1, 1, 1], "UInt8", data=b"y")
    assert small2 and pytest.raises(XisfValidationError, xisf.read, xisf.write(unit))
