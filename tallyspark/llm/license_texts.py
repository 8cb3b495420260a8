"""Public licence texts and notices, as fixed values: what the scan of operator 3 looks for.

Key phrases, which must stand word for word, are in brackets. Holders' names and years are left out.
"""

from __future__ import annotations

MIT = """
[Permission is hereby granted, free of charge, to any person obtaining a copy] of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice [shall be included in all copies or substantial portions] of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""

ISC = """
[Permission to use, copy, modify, and/or distribute this software] for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS.
"""

BSD = """
[Redistribution and use in source and binary forms], with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code [must retain the above copyright notice], this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""

ZLIB = """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.
[Permission is granted to anyone to use this software for any purpose], including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions:
1. The origin of this software [must not be misrepresented]; you must not claim that you wrote the original software.
"""

APACHE = """
Licensed under the [Apache License, Version 2.0] (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""

GPL = """
This program is free software: you can redistribute it and/or modify it under the terms of the
[GNU General Public License] as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""

UNLICENSE = """
This is free and unencumbered software [released into the public domain].
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
"""

#: (label, text): whole texts or notices of several sentences, then single lines by which files name a licence.
TEXTS = (
    ("mit", MIT),
    ("isc", ISC),
    ("bsd", BSD),
    ("zlib", ZLIB),
    ("apache-2", APACHE),
    ("gpl", GPL),
    ("unlicense", UNLICENSE),
    ("mit", "[Permission is hereby granted, free of charge], to any person [obtaining a copy] of this software and associated documentation files"),
    ("apache-2", "licensed under the [Apache License, Version 2.0] the License you may not use this file except in compliance with the License"),
    ("gpl", "licensed under the [GNU General Public License]"),
    ("gpl", "under the terms of the [GNU General Public License]"),
    ("lgpl", "licensed under the [GNU Lesser General Public License]"),
    ("bsd", "[Redistribution and use in source and binary forms] with or without modification are permitted provided that"),
    ("isc", "[Permission to use, copy, modify] and or [distribute this software for any purpose] with or without fee is hereby granted"),
    ("mpl-2", "subject to the terms of the [Mozilla Public License], v. 2.0"),
    ("unlicense", "This is free and unencumbered software [released into the public domain]"),
    ("cc-by-sa", "licensed under [CC BY-SA]"),
    ("cc-by-nc", "licensed under [CC BY-NC]"),
    ("cc0", "[To the extent possible under law], the author has waived all copyright and related or neighboring rights"),
    ("all-rights-reserved", "copyright [all rights reserved]"),
)
