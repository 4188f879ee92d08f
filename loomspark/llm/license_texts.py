"""Public licence texts and the short notices that stand for a licence."""

import re
from pathlib import Path

_WHOLE = Path(__file__).parent / "licenses_full"

_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""

_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""

_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""


def _whole(name: str) -> tuple[str, ...]:
    """An entire text, and what is often passed on of it: the part up to the end of its terms, without
    or with that heading, or the terms alone where a preface and a note enclose them."""
    text = (_WHOLE / f"{name}.txt").read_text("utf-8")
    out = [text]
    if end := re.search(r"(?m)^ *END OF TERMS AND CONDITIONS *$", text):
        out += [text[: end.end()], text[: end.start()]]
    if name.startswith("CC-BY"):
        out.append(re.split(r"(?m)^=+$", text)[2])
    if name == "CC0-1.0":
        out.append(text[text.index("Statement of Purpose") :])
    return tuple(out)


def _notices(*names: str) -> tuple[str, ...]:
    heads = ("Licensed under ", "Licensed under the ", "Released under ", "Released under the ", "Distributed under the ", "This work is licensed under ", "This work is licensed under the ", "License: ", "SPDX-License-Identifier: ")
    return tuple(h + n for n in names for h in heads)


KNOWN = {
    "MIT": (_MIT_BODY, "MIT License\n\n" + _MIT_BODY, "The MIT License (MIT)\n\n" + _MIT_BODY, *_notices("MIT License", "MIT")),
    "BSD-2-Clause": (f"{_BSD_HEAD}\n\n{_BSD_TAIL}", f"BSD 2-Clause License\n\n{_BSD_HEAD}\n\n{_BSD_TAIL}", *_notices("BSD 2-Clause License", "BSD-2-Clause")),
    "BSD-3-Clause": (f"{_BSD_HEAD}\n\n{_BSD_THIRD}\n\n{_BSD_TAIL}", f"BSD 3-Clause License\n\n{_BSD_HEAD}\n\n{_BSD_THIRD}\n\n{_BSD_TAIL}", *_notices("BSD 3-Clause License", "BSD-3-Clause")),
    "ISC": (f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_TAIL}", *_notices("ISC License", "ISC")),
    "0BSD": (f"{_ISC_GRANT}.\n\n{_ISC_TAIL}", *_notices("0BSD")),
    "Zlib": (_ZLIB, "zlib License\n\n" + _ZLIB, *_notices("zlib License", "Zlib")),
    "Apache-2.0": (_APACHE_NOTICE, *_whole("Apache-2.0"), *_notices("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0")),
    "GPL-1.0": _whole("GPL-1.0"),
    "GPL-2.0": (*_whole("GPL-2.0"), *_notices("GNU General Public License, version 2", "GPL-2.0", "GPL-2.0-only")),
    "GPL-3.0": (*_whole("GPL-3.0"), *_notices("GNU General Public License, version 3", "GPL-3.0", "GPL-3.0-only")),
    "LGPL-2.0": _whole("LGPL-2.0"),
    "LGPL-2.1": _whole("LGPL-2.1"),
    "LGPL-3.0": (*_whole("LGPL-3.0"), *_notices("GNU Lesser General Public License, version 3", "LGPL-3.0")),
    "AGPL-3.0": _notices("GNU Affero General Public License, version 3", "AGPL-3.0"),
    "GFDL-1.2": _whole("GFDL-1.2"),
    "GFDL-1.3": _whole("GFDL-1.3"),
    "Artistic-1.0-Perl": _whole("Artistic-1.0-Perl"),
    "MPL-1.1": _whole("MPL-1.1"),
    "MPL-2.0": (*_whole("MPL-2.0"), *_notices("Mozilla Public License, version 2.0", "MPL-2.0")),
    "CC0-1.0": (*_whole("CC0-1.0"), *_notices("CC0 1.0", "CC0-1.0")),
    "CC-BY-4.0": (*_whole("CC-BY-4.0"), *_notices("CC BY 4.0", "CC-BY-4.0")),
    "CC-BY-SA-4.0": (*_whole("CC-BY-SA-4.0"), *_notices("CC BY-SA 4.0")),
    "CC-BY-NC-4.0": _notices("CC BY-NC 4.0"),
    "CC-BY-ND-4.0": _notices("CC BY-ND 4.0"),
    "CC-BY-NC-SA-4.0": _notices("CC BY-NC-SA 4.0"),
    "CC-BY-NC-ND-4.0": _notices("CC BY-NC-ND 4.0"),
}
