"""Licence texts and notices whose canonical digests the licence scan looks up."""

import pkgutil

# ---- fixed values: texts as their stewards publish them; placeholders stand in dropped lines --
_MIT_GRANT = """\
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""
_MIT_NOTICE = """\
The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
_MIT_WARRANTY = """\
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
_ISC_GRANT = """\
Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted"""
_ISC_WARRANTY = """\
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""
_BSD_GRANT = """\
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
_BSD_NAMES = """\
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
_BSD_WARRANTY = """\
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_ZLIB = """\
This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""
# Long texts, in files of `texts`; most end with advice on their use, which is often left out.
_FILES = (("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"),
          ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3.0", "LGPL-3"), ("MPL-2.0", "MPL-2.0"),
          ("CC0-1.0", "CC0-1.0"))
_END = "END OF TERMS AND CONDITIONS"


def _long_texts() -> list[tuple[str, str]]:
    found = []
    for license_id, name in _FILES:
        text = pkgutil.get_data("furrow.llm", f"texts/{name}.txt").decode()
        terms, end, _ = text.partition(_END)
        found += [(license_id, text)] + ([(license_id, terms + end), (license_id, terms)] if end
                                         else [])
    return found


# (licence id, whole text), each as published and in one line: owner statements end with their line
# or where a text begins, so that the long texts, which hold some, have another form in one line.
_AS_PUBLISHED = (
    *_long_texts(),
    ("MIT", "MIT License\n\n" + _MIT_GRANT + _MIT_NOTICE + _MIT_WARRANTY),
    ("MIT", _MIT_GRANT + _MIT_NOTICE + _MIT_WARRANTY),
    ("MIT-0", "MIT No Attribution\n\n" + _MIT_GRANT.replace(
        ", subject to the following conditions:", ".") + _MIT_WARRANTY),
    ("ISC", "ISC License\n\n" + _ISC_GRANT + """, provided that the above
copyright notice and this permission notice appear in all copies.
""" + _ISC_WARRANTY),
    ("ISC", _ISC_GRANT + """, provided that the above
copyright notice and this permission notice appear in all copies.
""" + _ISC_WARRANTY),
    ("0BSD", _ISC_GRANT + ".\n" + _ISC_WARRANTY),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_GRANT + _BSD_WARRANTY),
    ("BSD-2-Clause", _BSD_GRANT + _BSD_WARRANTY),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_GRANT + _BSD_NAMES + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_GRANT + _BSD_NAMES + _BSD_WARRANTY),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("Zlib", _ZLIB),
)
TEXTS = tuple((i, " ".join(text.split())) for i, text in _AS_PUBLISHED) + _AS_PUBLISHED
_CC_PARTS = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
_CC_KINDS = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
_CC_VERSIONS = (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"),
                ("2.0", "Generic"))


def _cc_lines(kind: str, version: str, area: str) -> list[str]:
    """Lines that name a Creative Commons licence by its short or long name or its SPDX id."""
    parts = "-".join(_CC_PARTS[part] for part in kind.split("-"))
    if version != "4.0":
        parts = parts.replace("NoDerivatives", "NoDerivs")
    short, long = f"CC {kind} {version}", f"Creative Commons {parts} {version} {area}"
    leads = ("", "Licensed under ", "This work is licensed under ")
    return [f"SPDX-License-Identifier: {short}",
            *(lead + name for lead in leads for name in (short, f"{short} {area}", long)),
            f"{long} License", *(f"{lead}{article} {long} License" for lead in leads[1:]
                                 for article in ("a", "the"))]


_CC_NOTICES = tuple(
    (f"CC-{kind}-{version}", line) for kind in _CC_KINDS for version, area in _CC_VERSIONS
    for line in _cc_lines(kind, version, area)) + tuple(
    ("CC0-1.0", line) for line in (
        "SPDX-License-Identifier: CC0-1.0",
        *(lead + name for lead in ("", "Licensed under ", "This work is licensed under ",
                                   "This work is marked with ", "Released under ")
          for name in ("CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"))))
# (licence id, a line that stands for it)
NOTICES = (
    *_CC_NOTICES,
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
)
# Spellings that count as one: pattern over lower-case words, and what stands for them.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"),
    ("sublicence", "sublicense"), ("sub license", "sublicense"),
    ("sub licence", "sublicense"),
    ("non infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"), ("organisation", "organization"),
    ("merchantibility", "merchantability"), ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"), ("https", "http"),
)
# -------------------------------------------------------------------------------------------
