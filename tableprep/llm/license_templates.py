"""License wording as templates: fixed values, in plain text.

Markup: ``<<beginOptional>>`` ... ``<<endOptional>>`` may be left out;
``<<var;max=N>>`` stands for up to N words of any kind.
"""

# Phrases of the base contract, each word in order.
BASE_PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# Notices and license texts.
TEMPLATES = (
    ("mit", "under <<beginOptional>>the terms of<<endOptional>> the <<beginOptional>>so called<<endOptional>> mit "
            "<<beginOptional>>expat<<endOptional>> license"),
    ("apache-2", "apache <<beginOptional>>software<<endOptional>> license <<beginOptional>>v<<endOptional>> "
                 "<<beginOptional>>version<<endOptional>> 2 0"),
    ("cc-by-nc", "creative commons attribution noncommercial <<var;max=2>> license"),
    ("cc-by", "cc by 4 0"),
    ("gpl-3", "gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>> "
              "<<beginOptional>>either<<endOptional>> version 3"),
    ("lgpl-3", "gnu lesser general public license <<beginOptional>>as published by the free software "
               "foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3"),
    ("mit-text", """permission is hereby granted free of charge to any person obtaining a copy of this software and
        associated documentation files the software to deal in the software without restriction including without
        limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the
        software and to permit persons to whom the software is furnished to do so subject to the following conditions
        the above copyright notice and this permission notice <<beginOptional>>including the next
        paragraph<<endOptional>> shall be included in all copies or substantial portions of the software the software
        is provided as is without warranty of any kind express or implied including but not limited to the warranties
        of merchantability fitness for a particular purpose and noninfringement in no event shall <<var;max=12>> be
        liable for any claim damages or other liability whether in an action of contract tort or otherwise arising
        from out of or in connection with the software or the use or other dealings in the software"""),
    ("isc-text", """permission to use copy modify and or distribute this software for any purpose with or without fee
        is hereby granted provided that the above copyright notice and this permission notice appear in all copies
        the software is provided as is and <<var;max=12>> disclaims all warranties with regard to this software
        including all implied warranties of merchantability and fitness in no event shall <<var;max=12>> be liable
        for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use
        data or profits whether in an action of contract negligence or other tortious action arising out of or in
        connection with the use or performance of this software"""),
    ("bsd-2-text", """redistribution and use in source and binary forms with or without modification are permitted
        provided that the following conditions are met <<beginOptional>>1<<endOptional>> redistributions of source
        code must retain the above copyright notice this list of conditions and the following disclaimer
        <<beginOptional>>2<<endOptional>> redistributions in binary form must reproduce the above copyright notice
        this list of conditions and the following disclaimer in the documentation and or other materials provided
        with the distribution this software is provided by <<var;max=12>> as is and any express or implied warranties
        including but not limited to the implied warranties of merchantability and fitness for a particular purpose
        are disclaimed in no event shall <<var;max=12>> be liable for any direct indirect incidental special exemplary
        or consequential damages including but not limited to procurement of substitute goods or services loss of use
        data or profits or business interruption however caused and on any theory of liability whether in contract
        strict liability or tort including negligence or otherwise arising in any way out of the use of this software
        even if advised of the possibility of such damage"""),
    ("bsd-3-text", """redistribution and use in source and binary forms with or without modification are permitted
        provided that the following conditions are met <<beginOptional>>1<<endOptional>> redistributions of source
        code must retain the above copyright notice this list of conditions and the following disclaimer
        <<beginOptional>>2<<endOptional>> redistributions in binary form must reproduce the above copyright notice
        this list of conditions and the following disclaimer in the documentation and or other materials provided
        with the distribution <<beginOptional>>3<<endOptional>> neither the name of <<var;max=12>> nor the names of
        <<var;max=4>> contributors may be used to endorse or promote products derived from this software without
        specific prior written permission this software is provided by <<var;max=12>> as is and any express or implied
        warranties including but not limited to the implied warranties of merchantability and fitness for a particular
        purpose are disclaimed in no event shall <<var;max=12>> be liable for any direct indirect incidental special
        exemplary or consequential damages including but not limited to procurement of substitute goods or services
        loss of use data or profits or business interruption however caused and on any theory of liability whether in
        contract strict liability or tort including negligence or otherwise arising in any way out of the use of this
        software even if advised of the possibility of such damage"""),
    ("apache-2-notice", """licensed under the apache license version 2 0 the license you may not use this
        <<var;max=4>> except in compliance with the license you may obtain a copy of the license at <<var;max=12>>
        unless required by applicable law or agreed to in writing software distributed under the license is
        distributed on an as is basis without warranties or conditions of any kind either express or implied see the
        license for the specific language governing permissions and limitations under the license"""),
)
