"""Licence scan: entire texts looked up by the digest of a canonical form.

The canonical form has no copyright lines, is in lower case, keeps only letters and digits,
and spells words that licences spell in more ways than one in one way. A document is a
licence if its whole canonical form is that of a known licence, with or without its title.

A null text counts as empty. Every row gives one row, repeated rows too, with a null licence
if nothing is known of its digest. An empty table gives no rows. Other columns are ignored.
"""
import hashlib
import re

from pyspark.sql import functions as F

COPYRIGHT = r"(?i)(^|\n)[\x20\t#*/;%!<-]*(copyright[\x20\t]*(\(c\)|©|[0-9<\[{:])|\(c\)[\x20\t]*[0-9<\[{]|©|all rights reserved)[^\n]*"
MARKS = r"[^\p{L}\p{N}]+"
# Spellings that count as equal.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non infringement", "noninfringement"),
    ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("wilful", "willful"), ("fulfil", "fulfill"),
    ("judgement", "judgment"), ("labour", "labor"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("https", "http"),
)
DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
# Licence name, title, text.
KNOWN = (
    ("MIT", "MIT License", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MIT-0", "MIT No Attribution", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Unlicense", "The Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <http://unlicense.org/>"""),
    ("BSD-2-Clause", "BSD 2-Clause License", CLAUSES + DISCLAIMER),
    ("BSD-3-Clause", "BSD 3-Clause License", CLAUSES + NAMES + DISCLAIMER),
    ("ISC", "ISC License", GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + AS_IS),
    ("0BSD", "BSD Zero Clause License", GRANT + ".\n" + AS_IS),
    ("Zlib", "zlib License", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
)

# Digests of the canonical forms of longer licences, as Debian's common-licenses hold them.
DIGESTS = (
    ("c8576ae30a0b39e9ce2d6e4bd15cfad76430fbf141a7db3a73e6e782c02e29f5", "Apache-2.0"),
    ("68b9dd49ed1b1348e977ccc2468570a603d8075ede45354e352319821ca5469a", "Artistic-1.0"),
    ("481fcd9d007056b7809322c536d09d5f021334ccf6c013607eb2ed218774d076", "BSD-3-Clause"),
    ("0a1be2017ec8d38dbb0dfb4f86e1c257728a1669c7fe4d3aa53a1c459e1018ee", "CC0-1.0"),
    ("e91eb5f9d5d9856213578f733f5ae52f5692c9fc3cc1b05d048aff37a05aaeea", "GFDL-1.2"),
    ("5e719d42b044f5a2be4336c9e91d4860266cc46522216361f4c9ccbb621b3657", "GFDL-1.3"),
    ("869d156f07824e4287a2959e638586941efcb3774b5e407be30ff180ac13548b", "GPL-1.0"),
    ("64a86f1d3531a8b5c1d2f564c01882c63b58c93fbfb517279bfaa9a261cb1796", "GPL-2.0"),
    ("fbf4c7854913caaf09c170805455959454d9447e36e4d6495f74d232da3fc175", "GPL-3.0"),
    ("4921f4e1e5e73369d202e5c7683c965b4d275ba35f23c50d389e92705d9cc84e", "LGPL-2.0"),
    ("a65b75d251fb56c535ec7079440f5d167ec95725dd20f1d16677176defe487a3", "LGPL-2.1"),
    ("572947626844a56d29ace510237040204d4085696621f319533ca366aa897913", "LGPL-3.0"),
    ("ccf563bf7e9602ddc84771c776f95cf289b0b370516e99218af854a38db125d1", "MPL-1.1"),
    ("085a00a7d5f35fd39ee7b08052486f5758ccc298a989a6393e2ce3ead8160650", "MPL-2.0"),
)


def pairs():
    """Spellings as they stand in the canonical form, where two blanks part words."""
    return [tuple(" " + w.replace(" ", "  ") + " " for w in p) for p in SPELLINGS]


def canonical(text):
    """Canonical form of a text column."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(COPYRIGHT), F.lit("\n"))
    t = F.concat(F.lit(" "), F.regexp_replace(F.lower(t), F.lit(MARKS), F.lit("  ")), F.lit(" "))
    for a, b in pairs():
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(t)


def digest(text):
    """The same for one str of ASCII, hashed."""
    t = re.sub(COPYRIGHT, "\n", text)
    t = " " + re.sub(r"[^a-z0-9]+", "  ", t.lower()) + " "
    for a, b in pairs():
        t = t.replace(a, b)
    return hashlib.sha256(t.strip(" ").encode()).hexdigest()


def known():
    return [(digest(head + text), name) for name, title, text in KNOWN for head in ("", title + "\n", "The " + title + "\n")] + list(DIGESTS)


def scan(docs):
    """doc_id, digest of the canonical form, licence; the known table has a fixed, small size."""
    k = docs.sparkSession.createDataFrame(known(), "digest string, licence string")
    d = docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    return d.join(F.broadcast(k), "digest", "left").select("doc_id", "digest", "licence")


def sql():
    t = f"' ' || regexp_replace(lower(regexp_replace(coalesce(text, ''), '{COPYRIGHT}', chr(10), 'g')), '{MARKS}', '  ', 'g') || ' '"
    for a, b in pairs():
        t = f"replace({t}, '{a}', '{b}')"
    rows = ", ".join(f"('{d}', '{n}')" for d, n in known())
    return f"WITH k(digest, licence) AS (VALUES {rows}), d AS (SELECT doc_id, sha256(trim({t})) AS digest FROM documents) SELECT doc_id, digest, licence FROM d LEFT JOIN k USING (digest)"
