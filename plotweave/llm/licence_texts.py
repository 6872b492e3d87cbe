"""Bodies of well-known short licences, as published. Copyright lines are left out; the scan drops them."""

MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
MIT_DISCLAIMER = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE."
)
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_DISCLAIMER = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.\n"
)
BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission.\n"
)
BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
    "DAMAGE."
)
ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
    "the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it "
    "and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim "
    "that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
    "is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This "
    "notice may not be removed or altered from any source distribution."
)

KNOWN = {
    "MIT": f"MIT License\n\n{MIT_GRANT}, subject to the following conditions:\n\n{MIT_NOTICE}\n\n{MIT_DISCLAIMER}",
    "MIT (no title)": f"{MIT_GRANT}, subject to the following conditions:\n\n{MIT_NOTICE}\n\n{MIT_DISCLAIMER}",
    "MIT-0": f"MIT No Attribution\n\n{MIT_GRANT}.\n\n{MIT_DISCLAIMER}",
    "ISC": f"ISC License\n\n{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{ISC_DISCLAIMER}",
    "0BSD": f"BSD Zero Clause License\n\n{ISC_GRANT}.\n\n{ISC_DISCLAIMER}",
    "BSD-2-Clause": f"BSD 2-Clause License\n\n{BSD_HEAD}{BSD_DISCLAIMER}",
    "BSD-3-Clause": f"BSD 3-Clause License\n\n{BSD_HEAD}{BSD_NAMES}{BSD_DISCLAIMER}",
    "Zlib": f"zlib License\n\n{ZLIB}",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "MIT (notice)": "Released under the MIT License.",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
}

#: SHA-256 of the canonical forms of full licences, as Debian ships them in /usr/share/common-licenses.
FULL_DIGESTS = {
    "Apache-2.0": "9c4d471809a25cd2445360b904f6c85e522be6fef6e1f7462e21f31db8896519",
    "Apache-2.0 (no appendix)": "0376fbd9ea0ddea828183542d1540264744d9bab59bf617bdcc7ab10ccea255c",
    "Artistic-1.0-Perl": "e52250d769ff711c1a04996f474d60ff062a680546c6baf8b76ce50e1e5f6dd1",
    "CC0-1.0": "c8822a12bb596eda3abd7cb3cf2117a8fbf626ed60d9d5d9bda63e836eb7f09d",
    "GFDL-1.2": "b2adbb7f22c32c9217a7e3fbf344068c72203c0002d6e5a11eecbb43dfd5b4ae",
    "GFDL-1.3": "4e2013887766abfb18600d66252bf85ed738c228fa082e01fcf953afbc5bd3d0",
    "GPL-1.0": "57d421df06df8f4667d4fff6746e61e1769358f130a7bcc4be26dc41216c724d",
    "GPL-2.0": "c88338aac528a84c17073f24d919cbe7b15e63143024b25e2a905d9f344dedaf",
    "GPL-3.0": "bd59f54e09774f480a43d07abdde96ace1f2d9cfa4074e84d3d1ac8b70dd45b2",
    "LGPL-2.0": "d3b584de47fa8e87c9ab21e386e0a7fd7c9cfe750510c05d36cd5041bda1cd85",
    "LGPL-2.1": "111277ff6dd4e07e51b46c87d054e3195051a3cbea9d9ec29e30c7cd302a0ebc",
    "LGPL-3.0": "8e3b59e0c5c93d34fda7b8dba2cffff98d7a1ca97ef3c09ee49ab0e1c92338ac",
    "MPL-1.1": "769ca511e7107770841e98b8c1831c741c65ea88f16dd4d2be5fefc5ad9c04c4",
    "MPL-2.0": "3912cd2abe65769114fdafa2e7f92939c9eec02b5405577df3885e44016380a1",
}
