"""License texts, headers and notices as they stand in files, without copyright lines."""

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so"""
_MIT_CONDITION = """, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software"""
_MIT_WARRANTY = """.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_ADVERTISING = """3. All advertising materials mentioning features or use of this software must display the following
acknowledgement: This product includes software developed by the organization.
"""
_BSD_NAMES = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
"""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_CONDITION = ", provided that the above copyright notice and this permission notice appear in all copies"
_ISC_WARRANTY = """.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""

_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS
IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""


def _gnu(name: str, version: str, thing: str = "program") -> str:
    return f"""This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as
published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.
You should have received a copy of the GNU {name} along with this {thing}. If not, see <https://www.gnu.org/licenses/>."""


def _gnu_preamble(version: str, first: str) -> str:
    return f"""GNU GENERAL PUBLIC LICENSE Version {version}. Everyone is permitted to copy and distribute verbatim copies of
this license document, but changing it is not allowed. Preamble {first}"""


_GPL2_PREAMBLE = """The licenses for most software are designed to take away your freedom to share and change it. By contrast,
the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the
software is free for all its users."""
_GPL3_PREAMBLE = """The GNU General Public License is a free, copyleft license for software and other kinds of works. The
licenses for most software and other practical works are designed to take away your freedom to share and change the works.
By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a
program--to make sure it remains free software for all its users."""

_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

_CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}

TEXTS = [
    ("mit", _MIT_GRANT + _MIT_CONDITION + _MIT_WARRANTY),
    ("mit-0", _MIT_GRANT + _MIT_WARRANTY),
    ("bsd-2-clause", _BSD_GRANT + _BSD_WARRANTY),
    ("bsd-3-clause", _BSD_GRANT + "3. " + _BSD_NAMES + _BSD_WARRANTY),
    ("bsd-4-clause", _BSD_GRANT + _BSD_ADVERTISING + "4. " + _BSD_NAMES + _BSD_WARRANTY),
    ("isc", _ISC_GRANT + _ISC_CONDITION + _ISC_WARRANTY),
    ("0bsd", _ISC_GRANT + _ISC_WARRANTY),
    ("apache-2.0", _APACHE),
    ("gpl-2.0", _gnu("General Public License", "2")),
    ("gpl-3.0", _gnu("General Public License", "3")),
    ("lgpl-2.1", _gnu("Lesser General Public License", "2.1", "library")),
    ("lgpl-3.0", _gnu("Lesser General Public License", "3")),
    ("agpl-3.0", _gnu("Affero General Public License", "3")),
    ("gpl-2.0", _gnu_preamble("2, June 1991", _GPL2_PREAMBLE)),
    ("gpl-3.0", _gnu_preamble("3, 29 June 2007", _GPL3_PREAMBLE)),
    ("mpl-2.0", _MPL),
    *((f"cc-{k}-4.0", f"This work is licensed under a Creative Commons {v} 4.0 International License.") for k, v in _CC.items()),
    *((f"cc-{k}-4.0", f"Licensed under CC {k.upper()} 4.0.") for k in _CC),
]
