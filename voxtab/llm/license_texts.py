"""Licence notices in common use, as public texts: label, notice, phrases that must stand in it.

Fixed values. The wording is that of the licences themselves.
"""

NOTICES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this
     software and associated documentation files (the "Software"), to deal in the Software without
     restriction, including without limitation the rights to use, copy, modify, merge, publish,
     distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
     Software is furnished to do so, subject to the following conditions: The above copyright notice
     and this permission notice shall be included in all copies or substantial portions of the
     Software.""",
     ["permission is hereby granted free of charge", "to deal in the software without restriction"]),
    ("mit", "Released under the MIT License.", ["mit license"]),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this
     file except in compliance with the License. You may obtain a copy of the License at
     http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
     writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
     WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
     ["licensed under the apache license", "except in compliance with the license"]),
    ("apache", "Licensed under the Apache License, Version 2.0.", ["apache license version"]),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms
     of the GNU General Public License as published by the Free Software Foundation, either version 3
     of the License, or (at your option) any later version.""",
     ["gnu general public license", "published by the free software foundation"]),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.",
     ["gnu general public license"]),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms
     of the GNU Lesser General Public License as published by the Free Software Foundation; either
     version 2.1 of the License, or (at your option) any later version.""",
     ["gnu lesser general public license"]),
    ("agpl", """This program is free software: you can redistribute it and/or modify it under the terms
     of the GNU Affero General Public License as published by the Free Software Foundation, either
     version 3 of the License, or (at your option) any later version.""",
     ["gnu affero general public license"]),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are
     permitted provided that the following conditions are met: Redistributions of source code must
     retain the above copyright notice, this list of conditions and the following disclaimer.
     Redistributions in binary form must reproduce the above copyright notice, this list of conditions
     and the following disclaimer in the documentation and/or other materials provided with the
     distribution.""",
     ["redistribution and use in source and binary forms", "with or without modification"]),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or
     without fee is hereby granted, provided that the above copyright notice and this permission
     notice appear in all copies.""",
     ["for any purpose with or without fee is hereby granted"]),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a
     copy of the MPL was not distributed with this file, You can obtain one at
     https://mozilla.org/MPL/2.0/.""",
     ["mozilla public license"]),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is
     free to copy, modify, publish, use, compile, sell, or distribute this software, either in source
     code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
     means.""",
     ["free and unencumbered software", "public domain"]),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event
     will the authors be held liable for any damages arising from the use of this software. Permission
     is granted to anyone to use this software for any purpose, including commercial applications, and
     to alter it and redistribute it freely, subject to the following restrictions.""",
     ["alter it and redistribute it freely"]),
    ("boost", """Boost Software License - Version 1.0. Permission is hereby granted, free of charge, to
     any person or organization obtaining a copy of the software and accompanying documentation covered
     by this license to use, reproduce, display, distribute, execute, and transmit the Software.""",
     ["boost software license"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ["cc by nc"]),
    ("cc-by-nc", """This work is licensed under a Creative Commons Attribution-NonCommercial 4.0
     International License.""", ["creative commons attribution noncommercial"]),
    ("cc-by", "Licensed under CC BY 4.0.", ["licensed under cc by 4 0"]),
    ("cc-by", """This work is licensed under a Creative Commons Attribution 4.0 International
     License.""", ["creative commons attribution 4 0"]),
]

#: Phrase and label, as the contract of the query gives them.
BASE_PHRASES = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
]
