"""Word lists, patterns and grade maps that Korean annual reports are read with.

They are plain data. Every operator takes its lists as arguments, and these are only the defaults
for that domain; tests on other languages pass their own.
"""

from __future__ import annotations

# Terms that no configuration may remove.
GOVERNANCE_PROTECT = ["이사", "감사", "이사회", "준법", "이해관계자", "사외이사", "감사위원회", "ESG위원회", "컴플라이언스", "위원회", "지배구조", "투명성", "내부통제", "주주"]
# Environmental and social terms.
SIGNAL_PRESERVE = ["온실가스", "탄소중립", "탄소", "탄소배출", "탄소발자국", "안전보건", "안전", "보건", "임직원", "고용", "다양성", "인권", "노동", "재생에너지", "태양광", "풍력", "수소", "폐기물", "오염", "생태계", "순환경제", "공급망", "협력사", "사회공헌", "지역사회", "배출량", "감축", "저감", "친환경", "기후변화", "기후"]
# Nouns of mandatory financial and legal disclosure.
BOILERPLATE_NOUNS = ["재무제표", "부채", "차입금", "자본금", "사채", "배당금", "원리금", "특수관계인", "당기순이익", "이자비용", "충당금", "매출액", "손익", "부채비율", "회사채", "원가", "연결재무제표", "연결", "주석", "장부", "회계", "정관", "의결권", "의결", "결의", "등기", "법인세", "상법", "공고", "위임"]
# Stop words; each list adds to the one before it.
STOP_MINIMAL = ["및", "또한", "이를", "통해", "위해", "관련", "대한", "등", "있다", "하다", "되다", "이다", "것", "수", "그"]
STOP_STANDARD = ["당사", "회사", "기업", "사업", "관련하여", "바탕으로", "해당", "경우", "현재", "기타", "다음", "이후", "이전", "아래", "위", "각각", "방법", "방식", "절차", "내용", "사항", "보고서", "기재", "작성"]
STOP_EXTENDED = ["기준", "기간", "항목", "결과", "과정", "단계", "수준", "규모", "범위", "목적", "대상", "주요", "전반", "향후", "기존", "신규", "상황", "조건", "운영", "관리", "수행", "활용", "진행", "비용", "금액", "자산", "이익", "투자", "연도", "분기", "전기", "당기"]
# Lines of mandatory disclosure.
BOILERPLATE_LINES = ["연결재무제표.*주석", "재무제표.*주석", "당기순이익.*전기.*비교", "부채비율.*산출", "자본금.*납입", "정기주주총회.*결의에.*의거", "주주총회.*결의", "원리금.*지급", "이자.*지급", "특수관계인.*거래", "특수관계인.*내역", "감사보고서.*첨부", "외부감사인.*의견", "법인세.*납부", "공시.*의무", "기재.*사항.*없음", "해당사항.*없음", "별도의.*공시"]
# Units whose numbers stay in the mode keep_quantity.
QUANTITY_UNITS = ["억원", "만원", "원", "%", "퍼센트", "톤", "tCO2", "GWh", "MW", "kWh"]
# Section headings, in the order they are tried.
SECTION_PATTERNS = {
    "II": [r"II[\.\s]*사업의\s*내용", r"Ⅱ[\.\s]*사업의\s*내용", r"제\s*2\s*장\s*사업의\s*내용", r"(?<!\d)2[\.\s]+사업의\s*내용", r"사업의\s*내용에\s*관한\s*사항"],
    "IV": [r"IV[\.\s]*이사의\s*경영진단", r"Ⅳ[\.\s]*이사의\s*경영진단", r"제\s*4\s*장\s*이사의\s*경영진단", r"(?<!\d)4[\.\s]+이사의\s*경영진단", r"경영진단\s*및\s*분석의견", r"이사의\s*경영진단\s*및\s*분석"],
    "VI": [r"VI[\.\s]*이사회\s*등", r"Ⅵ[\.\s]*이사회\s*등", r"제\s*6\s*장\s*이사회", r"(?<!\d)6[\.\s]+이사회\s*등", r"이사회\s*등\s*회사의\s*기관"],
}
# Where the financial statements begin; a section ends there.
HARD_STOPS = [
    r"VII[\.\s]*재무에\s*관한\s*사항", r"Ⅶ[\.\s]*재무에\s*관한\s*사항", r"제\s*7\s*장", r"VII[\.\s]", r"Ⅷ[\.\s]", r"독립된\s*감사의견\s*감사보고서", r"연결\s*재무제표\s*주석", r"별도\s*재무제표\s*주석", r"재무제표\s*작성\s*기준\s*및\s*중요한",
    r"(?m)^(현금및현금성자산|매출채권|유형자산|무형자산|선급금|미수금)\s*[\d,]", r"본\s*감사인은.*재무제표에\s*대하여", r"우리는.*재무제표를\s*감사하였습니다",
]
# Passage filter.
PASSAGE_GOVERNANCE = ["이사", "감사", "이사회", "준법", "이해관계자", "사외이사", "감사위원회", "위원회", "지배구조", "내부통제", "컴플라이언스"]
PASSAGE_BOILERPLATE = ["재무제표", "부채", "차입금", "자본금", "사채", "배당금", "원리금", "특수관계인", "당기순이익", "이자비용", "충당금", "연결재무제표", "주석", "정관", "의결권", "결의", "법인세", "회사채", "장부"]
PASSAGE_SIGNAL = ["온실가스", "탄소중립", "탄소", "안전보건", "임직원", "재생에너지", "태양광", "풍력", "폐기물", "공급망", "배출량", "감축", "저감", "기후변화"]
# Rule classifier.
GOVERNANCE_CORE = ["이사회", "감사위원회", "사외이사", "독립이사", "이사", "대표이사", "감사", "내부감사", "감사보고", "지배구조", "준법", "컴플라이언스", "윤리", "윤리경영", "투명성", "독립성", "이해충돌", "이해관계자", "ESG위원회", "ESG", "내부통제", "리스크관리", "보수위원회", "추천위원회", "이사후보"]
ENVIRONMENT_CORE = ["탄소중립", "온실가스", "탄소배출", "재생에너지", "친환경", "기후변화", "탄소발자국", "순환경제", "생물다양성", "에너지전환", "탄소", "탄소감축", "저탄소", "TCFD", "RE100", "SBT", "넷제로", "폐기물", "용수", "대기오염", "화학물질", "환경경영", "에너지효율", "신재생", "태양광", "풍력"]
SOCIAL_CORE = ["안전보건", "인권", "다양성", "포용", "공급망", "사회공헌", "산업재해", "임직원", "협력사", "상생", "차별금지", "안전", "보건", "직장", "고용", "근로", "복리후생", "지역사회", "CSV", "CSR", "교육훈련", "육아휴직", "여성임원", "장애인고용", "인재"]
GOVERNANCE_PARTS = ["이사", "감사", "지배", "준법", "윤리", "내부"]
AMBIGUOUS = ["주주", "총회", "주주총회", "공시", "가치", "경영", "보고", "위원회", "위원", "결의", "승인", "선임", "임기", "보수", "보상", "성과", "평가", "기준", "정관", "내규", "규정", "절차", "원칙", "방침", "보험", "계열", "자회사", "관계회사", "지주"]
BOILERPLATE_TOKEN_PATTERNS = [
    r"^(재무|연결|별도|통합)(제표|상태표|성과표|흐름표)", r"^(매출|영업|순|당기)(채권|이익|손실|비용)", r"^(차입|부채|자본|자산)(금|잉여금|비율)", r"^(이익|자본)잉여금$", r"^(특수|관계)(관계인|사)$", r"^(계약|약정|보증|담보)(서|금|부)",
    r"^(주주|배당)(총회|금|수익률|명부)", r"^(원리|이자|만기)(금|상환|지급)", r"^(사채|전환사채|신주인수권)", r"^(감가|상각|손상)(상각|차손|비용)", r"^(회계|세무|세금)(처리|기준|부담)", r"^(공시|신고|제출|공고)(서|일|의무)",
]
GENERIC_TOKEN_PATTERNS = [r"^(사업|영업|경영|운영)(계획|전략|방침|현황|실적)", r"^(시장|산업|업종)(현황|전망|동향|분석)", r"^(제품|서비스|솔루션)(개발|출시|판매)", r"^(연구|개발|투자)(개발|비|활동)", r"^[가-힣]{1}(하|되|있|없|된|한)(다|고|며|며|어|어서)?$"]
IDF_LOW, IDF_MIDDLE, IDF_HIGH = 0.15, 0.50, 1.00
# Grades. The second map is the one of later analyses.
GRADES = {"S": 7, "A+": 6, "A": 5, "B+": 4, "B": 3, "C": 2, "D": 1}
GRADES_LATER = {"A+": 7, "A": 6, "B+": 5, "B": 4, "C": 3, "D": 2}
