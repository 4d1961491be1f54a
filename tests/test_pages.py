"""Pages of a folder with sizes from headers."""

import struct

from quirefold.sources import rosters


def test_read_pages(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 640, 480) + b"\x08\x02"
    jpeg = b"\xff\xd8\xff\xe1\x00\x10" + b"x" * 14 + b"\xff\xff\xc0\x00\x11\x08" + struct.pack(">HH", 33, 44)
    extended = b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\0\0\0\0" + (799).to_bytes(3, "little") + (1199).to_bytes(3, "little")
    lossy = b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0abc\x9d\x01\x2a" + struct.pack("<HH", 0x4000 | 321, 123)
    lossless = b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + ((65 - 1) | (77 - 1) << 14).to_bytes(4, "little")
    bmp = b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, 51, -52)
    gif = b"GIF89a" + struct.pack("<HH", 7, 9)
    ispe = lambda w, h: b"\0\0\0\x14ispe\0\0\0\0" + struct.pack(">II", w, h)
    avif = b"\0\0\0\x1cftypmif1\0\0\0\0mif1avif" + b"meta" + ispe(160, 90) + ispe(1920, 1080)
    files = {"p10.PNG": png, "p2.jpg": jpeg, "p1.webp": extended, "p3.WebP": lossy, "p4.webp": lossless, "a.bmp": bmp, "b.gif": gif, "c.avif": avif,
             "bad.png": b"\x89PNG", "no.jpeg": b"\xff\xd8\xff\xda\0\0", "empty.gif": b"", "a b+c.png": png, ".hidden.png": png, "notes.txt": png}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = [(r["name"], r["width"], r["height"]) for r in rosters.read_pages(spark, str(tmp_path)).orderBy("seq").collect()]
    want = {"p10.PNG": (640, 480), "p2.jpg": (44, 33), "p1.webp": (800, 1200), "p3.WebP": (321, 123), "p4.webp": (65, 77), "a.bmp": (51, 52), "b.gif": (7, 9), "c.avif": (1920, 1080), "bad.png": (0, 0), "no.jpeg": (0, 0), "a b+c.png": (640, 480)}
    assert {n: (w, h) for n, w, h in got} == want
    names = [n for n, *_ in got]
    assert [n for n in names if n.startswith("p")] == ["p1.webp", "p2.jpg", "p3.WebP", "p4.webp", "p10.PNG"]
